"""The network learns from every training text."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from floodlake.llm import bytetext, gru


def test_network_trains_on_all_training_rows(spark, monkeypatch):
    seen = []
    train = gru.train

    def watched(docs, *rest, **named):
        seen.extend(r.text for r in docs.collect())
        return train(docs, *rest, **named)

    monkeypatch.setattr(gru, "train", watched)
    rows = [(i, f"a b word{i} c") for i in range(200)]
    gru.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert sorted(seen) == sorted(t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)


def test_a_pass_takes_every_token(monkeypatch):
    v = gru.Vocabulary(bytetext.mix(np.arange(4, dtype=np.uint64)), np.array([9.0, 5, 3, 2]), 30, 8, np.full(gru.SPELLINGS, 2.0), np.full(gru.SPELLINGS, 1.0), np.zeros(4, np.int64))
    net = gru.Network(v)
    net.start_from_counts(v)
    texts = ["x y z " * n for n in range(1, 70)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[at : at + 10]}) for at in range(0, len(texts), 10)]
    want = sum(len(t.split()) + 1 for t in texts)
    for portion in (1 << 20, 500):
        monkeypatch.setattr(gru, "PORTION", portion)
        weights, tokens = gru._train(iter(batches), v, net.weights, gru.RATE)
        assert tokens == want and np.isfinite(weights).all()


def test_weights_are_averaged_level_by_level(spark):
    rng = np.random.default_rng(3)
    for tasks, fan_in in ((1, 4), (5, 64), (20, 3), (27, 3)):
        made = [(int(t), int(rng.integers(1, 50)), rng.normal(size=9).astype(np.float32)) for t in rng.permutation(2 * tasks)[:tasks]]
        frame = spark.createDataFrame([(t, n, bytearray(w.tobytes())) for t, n, w in made], "task int, tokens long, weights binary")
        want = sum(n * w.astype(float) for _, n, w in made) / sum(n for _, n, _ in made)
        assert np.allclose(gru.averaged(frame, fan_in), want, atol=1e-5)
    assert gru.averaged(frame.limit(0)) is None


def test_windows_score_as_one_pass_over_each_text(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 15, 16, 17, 31, 32, 33, 200, 5, 64, 0)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    _, v = gru.count_tokens(frame)
    net = gru.Network(v)
    net.start_from_counts(v)
    net.weights += rng.normal(scale=0.3, size=len(net.weights)).astype(np.float32)
    held = list(bytetext.slices(pa.array(texts), lower=True))
    ((sizes, total, *_),) = gru._score_batch(held, v, net)
    (w,) = held
    h, index, classes, inputs, first = gru._encode(w, v)
    for i in range(len(texts)):
        state, before, want = np.zeros((1, gru.HIDDEN), dtype=np.float32), net.start, 0.0
        for t in range(first[i], first[i + 1]):
            _, after, _ = net.states(np.array([[before]]), state)
            state = after[-1]
            want += net.log_classes(state)[0, classes[t]]
            if 0 <= index[t] < v.learned:
                want += net.log_inside(state, classes[t : t + 1], np.array([index[t] % gru.CLASS_SIZE]))[0]
            want += v.inside[index[t]] * np.log(10) if index[t] >= 0 else 0.0
            before = inputs[t]
        assert sizes[i] == first[i + 1] - first[i] and abs(total[i] - want / np.log(10)) < 1e-3 * max(1, sizes[i] / 16)
