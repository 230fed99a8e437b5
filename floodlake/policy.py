"""Parameters of the flood-impact operators, all in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Policy:
    """Defaults are the published behaviour; every operator takes a policy."""

    # Scene pairing.
    initial_window_days: int = 12
    max_window_days: int = 96
    window_multiplier: int = 2
    minimum_aoi_coverage: float = 0.8
    long_gap_warning_days: int = 24
    weight_overlap: float = 0.25
    weight_pre_closeness: float = 0.25
    weight_post_closeness: float = 0.25
    weight_same_platform: float = 0.10
    weight_coverage: float = 0.15
    # Areas of interest.
    min_aoi_area_km2: float = 0.1
    max_aoi_area_km2: float = 5000.0
    # Grids and hazard.
    flood_threshold: float = 0.5
    tile_size: int = 224
    tile_overlap: int = 32
    minimum_region_km2: float = 0.001
    change_threshold_db: float = 3.0
    backscatter_clip: float = 0.15
    input_mean: tuple[float, float] = (0.0953, 0.0264)
    input_std: tuple[float, float] = (0.0427, 0.0215)
    slope_mean: float = 2.9482
    slope_std: float = 79.2493
    # Exposure.
    building_fraction: float = 0.1
    road_potential_fraction: float = 0.01
    road_blocked_fraction: float = 0.5
    bridge_buffer_m: float = 20.0
    bridge_block_on_contact: bool = True
    bridge_overlap_fraction: float = 0.1
    # Road network; speeds in km/h by class of road.
    max_snap_m: float = 500.0
    detour_ratio: float = 1.25
    speeds: dict[str, float] = field(
        default_factory=lambda: {
            "motorway": 90.0,
            "trunk": 70.0,
            "primary": 60.0,
            "secondary": 50.0,
            "tertiary": 40.0,
            "unclassified": 30.0,
            "residential": 30.0,
            "service": 20.0,
            "track": 15.0,
        }
    )

    def __post_init__(self) -> None:
        weights = self.weight_overlap + self.weight_pre_closeness + self.weight_post_closeness + self.weight_same_platform + self.weight_coverage
        if abs(weights - 1) > 1e-9:
            raise ValueError("the weights of a pair's score must sum to one")
        if self.max_window_days < self.initial_window_days:
            raise ValueError("the largest window is smaller than the first")
        if self.tile_size % 16 or 2 * self.tile_overlap >= self.tile_size:
            raise ValueError("tiles are multiples of 16 and larger than twice their overlap")

    @property
    def windows(self) -> list[int]:
        """The ladder of search windows in days; the last is the largest allowed."""
        ladder, days = [], self.initial_window_days
        while days < self.max_window_days:
            ladder.append(days)
            days *= self.window_multiplier
        return [*ladder, self.max_window_days]


DEFAULT = Policy()
