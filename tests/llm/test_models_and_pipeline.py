"""Language-model scoring, media copies and the pipeline's stages."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm, media
from lodestone.llm.common import written

JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def words(t: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w] + [""]


def lm_rows() -> list[tuple]:
    rng = random.Random(6)
    known = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(known[: rng.choice((5, 60))]) for _ in range(rng.randrange(1, 120)))) for i in range(120)]
    return [*rows, (500, None), (501, ""), (502, "\t \n"), (503, "Ä ä A a"), (504, "long " * 30_000), (505, "never-seen-1 never-seen-2"), (506, "x" * 5000)]


def test_lm_base_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 10)  # so that most words go by the join
    rows = lm_rows()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(4)
    got = {r.doc_id: r for r in lm.score(df, JSON, PATTERN).collect()}
    counts, n, v = brute_counts(rows)
    for i, t in rows:
        w = words(t)
        base = sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert np.isfinite(r.score) and r.score < 0
    assert lm.score(df.limit(0), JSON, PATTERN).collect() == []


def brute_counts(rows):
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    return counts, sum(counts.values()), len(counts)


def test_chunks_hold_every_window():
    sizes, rng = np.array([1, 24, 25, 700, 193, 24 * 8, 24 * 8 + 1]), np.random.default_rng(2)
    ids, hashes = rng.integers(0, 50_000, sizes.sum()), rng.integers(-(1 << 62), 1 << 62, len(sizes))
    w, h = lm.stored_chunks(ids, sizes, hashes)
    x, y, real, scored = lm.chunk_windows(w)
    place, is_real, is_scored, _ = lm.windows(sizes)
    before = lm.inputs(ids, sizes)
    rows = lambda x, y, real, scored: sorted(zip(np.where(real, x.astype(int), -1).tolist(), np.where(scored, y.astype(int), -1).tolist(), strict=True))
    assert rows(x, y, real, scored) == rows(before[place], ids[place[:, lm.BACK :]], is_real, is_scored)
    assert scored.sum() == sizes.sum() and len(set(h.tolist())) == len(w)


def sentences(n: int, seed: int) -> list[tuple]:
    """Texts in which a word depends on another some words before it."""
    rng, rows = random.Random(seed), []
    pairs = {f"open{i}": f"close{i}" for i in range(12)}
    for i in range(n):
        words = []
        while len(words) < 120:
            k = rng.choice(list(pairs))
            words += [k, *("the" if rng.random() < 0.5 else "of" for _ in range(3)), pairs[k]]
        rows.append((i, " ".join(words)))
    return rows


def test_attention_makes_held_out_texts_likelier(spark):
    df = spark.createDataFrame(sentences(1200, 4), "doc_id long, text string")
    whole = {(r.doc_id, r.held_out): r.score for r in lm.score(df.repartition(7), JSON, PATTERN).collect()}
    again = {(r.doc_id, r.held_out): r.score for r in lm.score(df.repartition(2), JSON, PATTERN).collect()}
    assert all(again[k] == pytest.approx(x, rel=1e-3) for k, x in whole.items())  # however the input is partitioned
    without = {(r.doc_id, r.held_out): r.score for r in lm.score(df, JSON, PATTERN, attend=False).collect()}
    held = [k for k in whole if k[1]]
    assert len(held) > 100 and sum(whole[k] > without[k] for k in held) > 0.95 * len(held)


def test_large_logits_stay_finite():
    p = lm.unpack(lm.initial(np.zeros(lm.CLASSES, np.float32)).copy())
    for name in ("qe", "kv", "w"):
        p[name] *= 3000
    place, real, _, _ = lm.windows(np.array([60]))
    x = np.random.default_rng(0).integers(0, lm.BUCKETS, 60)
    assert np.isfinite(lm.forward(p, x[place], real)[-1]).all()


def test_windows_score_each_position_once():
    sizes = np.array([1, 24, 25, 100, 7])
    place, real, scored, doc = lm.windows(sizes)
    seen = place[:, lm.BACK :][scored]
    assert sorted(seen) == list(range(sizes.sum()))
    assert (np.bincount(doc) == -(-sizes // lm.STRIDE)).all() and real[:, lm.BACK :][scored].all()


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    flat = lm.initial(np.zeros(lm.CLASSES, np.float32)).astype(np.float64)
    sizes = np.array([30, 5])
    x, y = rng.integers(0, lm.BUCKETS, 35), rng.integers(0, lm.CLASSES, 35)
    place, real, scored, _ = lm.windows(sizes)
    kind = y[place][:, lm.BACK :]

    def loss(f):
        z = lm.forward(lm.unpack(f), x[place], real)[-1].astype(np.float64)
        p = z - np.log(np.exp(z).sum(1, keepdims=True))
        return -(p[np.arange(len(p)), kind.ravel()] * scored.ravel()).sum() / scored.sum()

    g = lm.gradient(lm.unpack(flat), x[place], kind, real, scored)
    move = rng.normal(size=len(flat))
    slope = (loss(flat + 1e-5 * move) - loss(flat - 1e-5 * move)) / 2e-5
    assert slope == pytest.approx(float(g @ move), rel=1e-2)


def plain_gradient(p, x, y, real, scored):
    """As lm.gradient, by the formulas: softmax with the largest taken from each row, normalised weights, sums by position."""
    qe, kv = p["qe"][x[:, lm.BACK :]], p["kv"][x]
    q, k, v = qe[..., : lm.DIM] * np.float32(lm.DIM**-0.5), kv[..., : lm.DIM], kv[..., lm.DIM :]
    a = np.matmul(q, k.transpose(0, 2, 1)) + np.where(lm.AGO >= 0, p["near"][np.maximum(lm.AGO, 0)], np.float32(-1e9)) - np.where(real, np.float32(0), np.float32(1e9))[:, None, :]
    a = np.exp(a - a.max(2, keepdims=True))
    a /= a.sum(2, keepdims=True)
    h = np.concatenate((np.matmul(a, v), qe[..., lm.DIM :]), 2)
    z = h.reshape(-1, 2 * lm.DIM) @ p["w"][:-1] + p["w"][-1]
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(z)), y.ravel()] -= 1
    z *= (scored.ravel() / np.float32(scored.sum())).astype(z.dtype)[:, None]
    dh = (z @ p["w"][:-1].T).reshape(h.shape)
    do = dh[..., : lm.DIM]
    ds = np.matmul(do, v.transpose(0, 2, 1))
    ds = a * (ds - (do * h[..., : lm.DIM]).sum(2, keepdims=True))
    dkv = np.concatenate((np.matmul(ds.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), do)), 2)
    dqe = np.concatenate((np.matmul(ds, k) * np.float32(lm.DIM**-0.5), dh[..., lm.DIM :]), 2)

    def by_row(rows, values):
        c = values.shape[-1]
        return np.bincount((rows.reshape(-1, 1) * c + np.arange(c)).ravel(), values.ravel(), lm.BUCKETS * c)

    near = np.bincount(np.maximum(lm.AGO, 0).ravel(), np.where(lm.AGO >= 0, ds.sum(0), 0).ravel(), lm.WINDOW)
    return np.concatenate([g.astype(np.float32) for g in (by_row(x[:, lm.BACK :], dqe), by_row(x, dkv), near, (h.reshape(-1, 2 * lm.DIM).T @ z).ravel(), z.sum(0))])


@pytest.mark.parametrize("size", [1, 300])  # with large numbers, rows are lowered by their largest first
def test_a_training_step_does_what_the_formulas_say_in_less_time(size):
    rng = np.random.default_rng(5)
    flat = lm.initial(np.zeros(lm.CLASSES, np.float32))
    flat *= size
    p, sizes = lm.unpack(flat), np.array([700, 9, 33, 420])
    place, real, scored, _ = lm.windows(sizes)
    x, kind = rng.integers(0, lm.BUCKETS, sizes.sum())[place], rng.integers(0, lm.CLASSES, sizes.sum())[place][:, lm.BACK :]
    want, got = plain_gradient(p, x, kind, real, scored), lm.gradient(p, x, kind, real, scored)
    assert abs(want - got).max() < 1e-4 * abs(want).max()

    def least(f):
        times = []
        for _ in range(40):
            t = time.process_time()
            f(p, x, kind, real, scored)
            times.append(time.process_time() - t)
        return min(times)

    assert size > 1 or least(lm.gradient) < 0.7 * least(plain_gradient)


def picture(seed: int, h: int = 160, w: int = 160) -> np.ndarray:
    rng = np.random.default_rng(seed)
    img = np.zeros((h, w), np.uint8)
    for _ in range(90):
        y, x, a, b = rng.integers(0, h - 12), rng.integers(0, w - 12), *rng.integers(5, 14, 2)
        img[y : y + a, x : x + b] = rng.integers(30, 255)
    return img


def test_media_copies(spark):
    pics = {10: picture(1), 11: picture(1)[20:, 24:], 12: picture(1).copy(), 20: picture(2), 21: picture(2).copy(), 30: picture(3), 40: np.zeros((5, 5), np.uint8), 41: np.zeros((5, 5), np.uint8)}
    pics[12][60:90, 60:90] = 0  # edited
    rows = [(i, p.shape[1], p.shape[0], p.tobytes(), 1) for i, p in pics.items()] + [(50, None, None, None, 1), (51, 4, 4, b"abc", 1), (20, 160, 160, picture(2).tobytes(), 1)]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary, class_id int")
    got = media.copies(df, "id").collect()
    assert len(got) == len(rows)
    assert {r.id: r.class_id for r in got} == {10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 30: 30, 40: 40, 41: 40, 50: 50, 51: 51}
    assert media.copies(df.limit(0), "id").collect() == []


def halved(p: np.ndarray) -> np.ndarray:
    return ((p[::2, ::2].astype(int) + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) // 4).astype(np.uint8)


def edited(p: np.ndarray) -> np.ndarray:
    out = p.copy()
    out[60:90, 60:90] = 0
    return out


CHANGES = {
    "crop": lambda p: p[20:, 24:], "small crop": lambda p: p[40:130, 30:130], "edit": edited, "brighter": lambda p: np.clip(p.astype(int) + 20, 0, 255).astype(np.uint8),
    "quarter turn": np.rot90, "half turn": lambda p: p[::-1, ::-1], "half size": halved, "double size": lambda p: p.repeat(2, 0).repeat(2, 1),
}


def brute_classes(pics: dict[int, np.ndarray]) -> dict[int, int]:
    """Classes by comparing all pairs of images, each corner with each."""
    ids = list(pics)
    found, keys, count = media.corners([pics[i] for i in ids])
    mine = [np.flatnonzero(found[:, 0] == i) for i in range(len(ids))]
    low = {i: i for i in ids}
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            at = [(i, j) for t in range(media.TABLES) for i in mine[a] for j in mine[b][keys[mine[b], t] == keys[i, t]]]
            weight = Counter()
            for vote, (i, j) in {(*v, i): (i, j) for v, (i, j) in zip(media.votes(found[[x[0] for x in at]], found[[x[1] for x in at]]).tolist(), at, strict=True)}.items() if at else ():
                weight[vote[:4]] += min(found[i, 5], found[j, 5])
            if max(weight.values(), default=0) >= max(media.CONSENSUS, media.SHARE * min(count[a], count[b])):
                x, y = low[ids[a]], low[ids[b]]
                low = {k: min(x, y) if v in (x, y) else v for k, v in low.items()}
    return low


def test_media_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(media, "BATCH", 7)  # so that most copies meet by the tables
    pics = {100 * s: picture(s) for s in range(1, 16)}
    for n, change in enumerate(CHANGES.values(), 1):
        pics |= {100 * s + n: np.ascontiguousarray(change(pics[100 * s])) for s in range(1, 16)}
    for s in range(16, 40):  # a patch that many share does not make copies of them
        pics[100 * s] = picture(s)
        pics[100 * s][:30, :30] = picture(1)[:30, :30]
    rows = [(i, p.shape[1], p.shape[0], p.tobytes()) for i, p in pics.items()]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary").repartition(5)
    got = {r.id: r.class_id for r in media.copies(df, "id").collect()}
    want = brute_classes(pics)
    pairs = [(a, b) for a in pics for b in pics if a < b]
    linked = [(a, b) for a, b in pairs if want[a] == want[b]]
    assert sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)
    assert not any(got[a] == got[b] and want[a] != want[b] for a, b in pairs)
    for n, name in enumerate(CHANGES, 1):
        assert sum(got[100 * s] == got[100 * s + n] for s in range(1, 16)) >= 0.9 * 15, name
    assert len({got[100 * s] for s in range(1, 40)}) == 39


@pytest.mark.parametrize("block", [256, 3])
def test_media_copies_behind_others_of_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(media, "BATCH", 1)  # all meet by the tables
    monkeypatch.setattr(media, "BLOCK", block, raising=False)
    whole, pics = picture(1), {}
    for n, (y, x) in enumerate((y, x) for y in range(0, 97, 24) for x in range(0, 97, 24)):
        for first in (0, 200):  # they stand first in the buckets and between the two that share more
            pics[first + n] = picture(1000 + first + n)
            pics[first + n][y : y + 64, x : x + 64] = whole[y : y + 64, x : x + 64]
    pics[100], pics[300] = whole, picture(700)
    pics[300][:110, :110] = whole[:110, :110]
    pics = dict(sorted(pics.items()))
    rows = [(i, p.shape[1], p.shape[0], p.tobytes()) for i, p in pics.items()]
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, width int, height int, pixels binary"), "id").collect()}
    assert got == brute_classes(pics) and got[300] == got[100]


def test_media_copies_of_pages_that_repeat_words(spark, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 4, raising=False)
    rng, html = random.Random(8), []
    for n in range(10):  # equal corners in long columns, which are matched by their runs
        texts = [" ".join(rng.choice(("esin", "thor", "rend", "eaingor", "of")) for _ in range(8)) + f" {w}" * rng.randrange(150, 300) for w in rng.sample(("esin", "rend", "eaingor", "ab", "abcdefg"), 2)]
        html.append(" ".join(texts))
    pics = {i: media.raster(*media.page_raster(h)) for i, h in enumerate(html)}
    pics[10], pics[11], pics[12] = (np.ascontiguousarray(f(pics[3])) for f in (lambda p: p[::-1, ::-1], np.rot90, lambda p: p.repeat(2, 0).repeat(2, 1)))
    rows = [(i, p.shape[1], p.shape[0], p.tobytes()) for i, p in pics.items()]
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, width int, height int, pixels binary"), "id").collect()}
    assert got == brute_classes(pics)
    found, keys, count = media.corners(list(pics.values()))
    at = found[:, 1] << 60 | found[:, 2] << 56 | (found[:, 5] - 1) << 55 | found[:, 3] << 28 | found[:, 4]
    tile = media.Tile(np.arange(len(pics)), np.arange(len(pics)), count, found[:, 0], keys.T, at)
    assert tile.len.sum() > 2 * len(tile.len)  # runs are fewer than entries
    for a in pics:  # each pair by itself, not by its class
        for b in range(a + 1, len(pics)):
            two = media.Tile(np.arange(2), np.arange(2), count[[a, b]], (found[:, 0] == b)[np.isin(found[:, 0], (a, b))].astype(np.int64), keys[np.isin(found[:, 0], (a, b))].T, at[np.isin(found[:, 0], (a, b))])
            assert bool(two.links()) == (len(set(brute_classes({0: pics[a], 1: pics[b]}).values())) == 1), (a, b)


def test_nearest_corners_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    p = rng.integers(0, 40, (600, 2))
    of = np.sort(rng.integers(0, 5, 600))
    of[-1] = 9
    order = np.lexsort((p[:, 0], p[:, 1], of))
    x, y = p[order].T
    d = ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2).astype(float)
    d[(of[:, None] != of) | np.eye(600, dtype=bool)] = np.inf
    assert (media.nearest(of, y, x) == np.where(np.isinf(d.min(1)), -1, d.argmin(1))).all()


def test_media_copies_of_odd_rows(spark):
    p, kind = picture(1), "class_id long, id long, width int, height int, pixels binary, n string"
    rows = [(1, None, 160, 160, p.tobytes(), ""), (1, None, 160, 160, p.tobytes(), ""), (1, 9, 140, 160, p[:, :140].tobytes(), ""), (1, 5, -160, -160, p.tobytes(), ""), (1, 6, -160, -160, p.tobytes(), ""), (1, 7, 160, 160, picture(2).tobytes(), ""), (1, 7, 160, 160, picture(3).tobytes(), ""), (1, 8, 160, 160, picture(3).tobytes(), ""), (1, None, 5, 5, bytes(25), ""), (1, None, None, None, None, "")]
    got = media.copies(spark.createDataFrame(rows, kind), "id").collect()
    assert sorted((r.id or 0, r.class_id or 0) for r in got) == [(0, 0), (0, 0), (0, 9), (0, 9), (5, 5), (6, 5), (7, 7), (7, 7), (8, 7), (9, 9)]
    none = media.page_media(spark.createDataFrame([], "page_id long, html string, width string"))
    assert none.collect() == [] and media.copies(none, "page_id").collect() == []


def test_page_rasters(spark):
    df = spark.createDataFrame([(1, "<p>Some words <b>here</b></p><script>no</script>"), (2, None), (3, ""), (4, "<div>Some words here</div>")], "page_id long, html string")
    got = {r.page_id: (r.width, r.height, bytes(r.pixels)) if r.pixels is not None else None for r in media.page_media(df).collect()}
    assert got[2] is None and got[1] == got[4] and got[3][1] == media.LINE


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_tables(spark, folder: str) -> list[tuple]:
    rng = random.Random(8)
    known = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(150):
        t = " ".join(rng.choice(known) for _ in range(80)) + "."
        if i % 5 == 0:
            t += " you are a stupid idiot. you moron. you are scum and trash." * 2
        if i % 7 == 0:
            t += f" mail me at user{i}@example.org"
        rows.append((i, t, "en", "hot" if i % 2 else f"s{i}", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + j, clean[0][1] + (" tail" if j % 2 else ""), None, None, None) for j in range(30)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows, d = pipeline_tables(spark, str(tmp_path)), str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    civil = dict(p.STAGES)["toxicity"](spark, docs, d)
    assert civil.columns == docs.columns
    assert {r.doc_id for r in civil.collect()} == {r[0] for r in rows if r[0] >= 1000 or r[0] % 5}
    one = dict(p.STAGES)["near duplicates"](spark, civil, d)
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and kept == {r[0] for r in rows if r[0] < 1000 and r[0] % 5} | {2000, 2001}
    blotted = dict(p.STAGES)["personal data"](spark, one, d)
    texts = {r.doc_id: r.text for r in blotted.collect()}
    assert blotted.columns == docs.columns and set(texts) == kept and not any("@" in (t or "") for t in texts.values()) and "[EMAIL]" in texts[7]
    packed = p.run(spark, d).collect()
    assert {r.doc_id for r in packed} == kept
    want = Counter()
    for r in packed:
        want[r.sequence_id] += r.length
    assert max(want.values()) <= 2048


def test_near_duplicates_keep_rows_without_an_id_and_with_reused_ids(spark):
    import corpus_pipeline as p

    texts = [" ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (None, texts[2]), (None, texts[3]), (None, texts[0]), (2, texts[4]), (None, texts[4] + " more"), (3, texts[5] + " more"), (3, texts[5]), (3, texts[2]), (None, None), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(3)
    got = [(r.doc_id, r.text) for r in dict(p.STAGES)["near duplicates"](spark, df, "").collect()]
    six = [(i, t) for i, t in got if i == 3 and t.startswith("f")]
    assert len(six) == 1
    want = [(1, texts[0]), (1, texts[1]), (3, texts[2]), (None, texts[3]), (2, texts[4]), (None, None), (4, None), (5, "")]
    assert sorted((x for x in got if x not in six), key=repr) == sorted(want, key=repr)


def test_near_duplicates_of_five_words(spark):
    """Copies of five-word similarity from 0.7 to 1 against a brute-force version."""
    import corpus_pipeline as p

    rng, texts = random.Random(11), []
    for size, edits in [(50, 1), (50, 2), (110, 2), (110, 3), (200, 4), (200, 6), (400, 8), (30, 1)] * 3:
        base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(2):
            copy = list(base)
            for at in range(edits):
                copy[(at + 1) * size // (edits + 1)] = f"new{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(sets)) for a in range(b)}
    assert sum(0.8 <= x < 0.9 for x in share.values()) > 5 and any(0.7 <= x < 0.8 for x in share.values())
    low = list(range(len(texts)))
    for a, b in (k for k, x in share.items() if x >= 0.8):
        low = [min(low[a], low[b]) if x in (low[a], low[b]) else x for x in low]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id for r in dict(p.STAGES)["near duplicates"](spark, df, "").collect()}
    assert got == {i for i, x in enumerate(low) if i == x}


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as p

    names = ["weight", "clauses", "strongest", "density", "score", "predicted", "base", "spans", "row", "keys", "n", "uid", "_row_id", "start", "length", "_read", "label"]
    pipeline_tables(spark, f"{tmp_path}/plain")
    docs = spark.read.parquet(f"{tmp_path}/plain/documents.parquet")
    docs = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names))
    docs.write.parquet(f"{tmp_path}/wide/documents.parquet")
    spark.read.parquet(f"{tmp_path}/plain/labels.parquet").write.parquet(f"{tmp_path}/wide/labels.parquet")
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = written(stage(spark, now, f"{tmp_path}/wide"), "wide")
        assert now.columns == docs.columns
        rows = now.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
    assert {r.doc_id for r in p.run(spark, f"{tmp_path}/wide").collect()} == {r.doc_id for r in rows}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
