import numpy as np
import pytest
from pyspark.sql import functions as F

from mendline.llm import hardnegatives

KIND = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, is_anchor, k=5, share=80):
    whole = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            row = (label, [int(np.floor(256 * x)) for x in v])
            whole[i] = min(whole.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(whole[a][1], whole[b][1]))
    out = []
    for a in filter(is_anchor, whole):
        ranked = sorted((-score(a, b), b) for b in whole if b != a)
        for s, p in [x for x in ranked if whole[x[1]][0] == whole[a][0]][:k]:
            wrong = [(n, t) for t, n in ranked if whole[n][0] != whole[a][0] and share * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(wrong)]
    return sorted(out)


def rows_of(seed, groups):
    pick = np.random.default_rng(seed)
    centres = pick.normal(0, 1, (groups, 6))
    vecs = (centres[pick.integers(0, groups, 300)] + pick.normal(0, 0.4, (300, 6))) * np.exp(pick.normal(0, 0.3, 300))[:, None]
    vecs = vecs.astype(np.float32)
    vecs[40:130] = vecs[3]  # a common vector under several labels
    labels = pick.integers(0, 3, 300)
    labels[60:120] = 1
    rows = [(i, [float(x) for x in v], int(n)) for i, (v, n) in enumerate(zip(vecs, labels))]
    return rows + [(300, None, 1), (310, [], 1), (320, [1.0, None], 1), (330, [float("nan")] * 6, 1), (340, [1.0] * 6, None), (350, [0.0] * 6, 2),
                   (360, [2.0, 1.0], 0), (None, [1.0] * 6, 0), (20, [0.1] * 6, 0), (20, [0.1] * 6, 2), rows[30], (370, [9000.0] * 6, 1)]


@pytest.mark.parametrize("seed,groups", [(1, 1), (2, 8)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, seed, groups):
    for name, value in (("TILE", 25), ("BLOCK", 4), ("PACK", 3), ("STEP", 60)):
        monkeypatch.setattr(hardnegatives, name, value)
    rows = rows_of(seed, groups)
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND + ", Cell string")
    got = hardnegatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_few_and_no_rows(spark):
    run = lambda rows: sorted(map(tuple, hardnegatives.hard_negatives(spark.createDataFrame(rows, KIND), F.col("vec_id") == 0).collect()))
    assert run([]) == run([(0, [1.0], 1)]) == run([(0, [1.0], 1), (1, [1.0], 2)]) == run([(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]) == []
    # A positive of score zero admits negatives of score zero.
    assert run([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 5.0], 2), (3, [1.0, 0.0], 2)]) == [(0, 1, 1, 2, 0, 0)]


def test_bounds_hold(monkeypatch):
    pick = np.random.default_rng(7)
    for spread in (0.001, 0.1, 2.0):
        rows = np.floor(256 * (pick.normal(0, 1, (1, 5)) + pick.normal(0, spread, (200, 5))))
        rows[3] = 0
        refs = hardnegatives.references(rows, 6)
        seen, lengths = hardnegatives.angles(rows, refs)
        stored = seen.astype(np.float32).astype(np.float64)
        exact = rows @ rows.T
        least, most = hardnegatives.pair_bounds(stored, lengths, stored, lengths)
        assert (least <= exact).all() and (exact <= most).all()
        tiles = [slice(i, i + 20) for i in range(0, 200, 20)]
        ranges = [np.array([f(x[t], axis=0) for t in tiles]) for f, x in ((np.min, stored), (np.max, stored), (np.min, lengths), (np.max, lengths))]
        low, high = hardnegatives.tile_bounds(stored, lengths, *ranges)
        for n, t in enumerate(tiles):
            assert (low[:, n, None] <= exact[:, t]).all() and (exact[:, t] <= high[:, n, None]).all()


def test_far_tiles_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "TILE", 50)
    pick = np.random.default_rng(3)
    vecs = np.repeat(np.eye(8) * 4, 100, axis=0) + pick.normal(0, 0.02, (800, 8))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vecs.astype(np.float32))]
    sent = []
    meeting = hardnegatives.Tiles.meeting

    def counted(self, blocks, same_label):
        pairs = meeting(self, blocks, same_label)
        sent.append((pairs.count(), blocks.count() * self.tiles.count()))
        return pairs

    monkeypatch.setattr(hardnegatives.Tiles, "meeting", counted)
    got = hardnegatives.hard_negatives(spark.createDataFrame(rows, KIND), F.col("vec_id") % 40 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i % 40 == 0)
    assert all(some < every / 4 for some, every in sent[1:])
