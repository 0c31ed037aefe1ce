"""Language-model scores against dictionaries of counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import bytesplit as bs
from colloquy.llm import catalog, lm_filter
from colloquy.llm.common import Scratch

OP = catalog.queries()["op12_lm_scores"]
END = object()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]


def quantised(n, least):
    if n < least:
        return 0
    level = int(lm_filter.levels_of(np.array([n]), least)[0])
    return float(lm_filter.count_of(np.array([level]), least)[0])


def plain(rows):
    """By row: doc_id, held_out, n_tokens, n_known, N, base score, and the score with quantised counts and no false hits."""
    one, two = Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            t = tokens(text)
            one.update(t)
            two.update(zip([END, *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    q1, q2 = {k: quantised(c, 1) for k, c in one.items()}, {k: quantised(c, 2) for k, c in two.items()}
    out = []
    for doc_id, text in rows:
        t = tokens(text)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip([END, *t[:-1]], t, strict=True):
            ch, cw = q1.get(h, 0), q1.get(w, 0)
            c = min(q2.get((h, w), 0), ch) if ch and cw else 0
            score += math.log10((c + lm_filter.MU * (cw + 1) / (n + v + 1)) / (ch + lm_filter.MU))
        out.append((doc_id, held(doc_id), len(t), sum(w in one for w in t), n, base, score))
    return out


def compare(got, rows, off=0.02):
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    theirs = sorted(plain(rows), key=repr)
    assert [m[:5] for m in mine] == [t[:5] for t in theirs]
    assert [m[5] for m in mine] == pytest.approx([t[5] for t in theirs], rel=1e-9)
    for m, t in zip(mine, theirs, strict=True):
        assert abs(m[6] - t[6]) <= off * abs(t[6]) + 6  # false hits: one changes a term by up to 3
    assert abs(sum(m[6] for m in mine) / sum(t[6] for t in theirs) - 1) < 0.005


@pytest.mark.parametrize("hot", [lm_filter.HOT, 50, 0])
def test_against_dictionaries(spark, hot):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(lm_filter.lm_scores(docs, hot=hot).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()]
    compare(OP(spark, odd_dir).collect(), rows)


def test_nothing_to_learn_from(spark):
    only = next(k for k in range(100) if held(k))
    (r,) = lm_filter.lm_scores(spark.createDataFrame([(only, "a b c")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0) and r.score == 0.0


def test_unseen_texts_score_lower_than_seen_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_filter.lm_scores(docs).collect()
    mean = lambda rows, c: sum(r[c] for r in rows) / sum(r.n_tokens for r in rows)
    out, learned = [r for r in got if r.held_out], [r for r in got if not r.held_out]
    assert len(out) > 100 and mean(out, "score") > mean(out, "base_score") and mean(learned, "score") > mean(out, "score")


def test_probabilities_of_a_history_sum_to_about_one(spark):
    texts = [b"the cat sat on the mat and the cat ran"] * 30 + [b"a dog sat on a mat"] * 20
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    model, words = lm_filter.learn(df, Scratch(spark, "t"))
    vocabulary = sorted({w for t in texts for w in t.split()})
    alone = {w: 10 ** model.score([w])["score"][0] for w in vocabulary}
    total = 0.0
    for w in vocabulary:  # of "the w" and the end, less those of "the" before it and of the end after it
        both = model.score([b"the " + w])["score"][0]
        end = model.score([w])["score"][0] - math.log10(alone_first(model, w))
        total += 10 ** (both - math.log10(alone_first(model, b"the")) - end)
    assert alone and 0.8 < total < 1.2


def alone_first(model, w):
    """P(w | end): the probability of a text that begins with w, by the model's own formula."""
    f, h = model.filter, bs.split([w])[0]
    t, starts = lm_filter.tokens([w])
    c = lambda x, least: lm_filter.count_of(f.levels(x), least)
    before = c(np.array([lm_filter.END]), 1)[0]
    two = min(c(lm_filter.pairs(t, starts)[1][:1], 2)[0], before)
    return (two + lm_filter.MU * (c(h, 1)[0] + 1) / (model.train_tokens + model.distinct + 1)) / (before + lm_filter.MU)


def test_filter_never_undercounts_and_rarely_overcounts():
    rng = np.random.default_rng(3)
    h = bs.seeds(60_000, 9)
    n = rng.zipf(1.5, 40_000).clip(1, 10**7)
    level = lm_filter.levels_of(n, 1)
    data, bits, floor = lm_filter.filter_block([(h[:40_000], level)], 1 << 24)
    f = lm_filter.Filter(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([bits]), np.array([floor]), 64)
    got = f.levels(h)
    assert floor == 1 and (got[:40_000] >= level).all()
    assert (got[:40_000] > level).mean() < 0.05 and (got[40_000:] > 0).mean() < 0.05


def test_a_filter_without_room_keeps_the_higher_levels():
    h, level = bs.seeds(10_000, 8), lm_filter.levels_of(np.arange(10_000) % 50 + 1, 1)
    data, bits, floor = lm_filter.filter_block([(h, level)], 1 << 16)
    f = lm_filter.Filter(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([bits]), np.array([floor]), 64)
    assert 1 << 14 < bits <= 1 << 16 and 1 < floor
    assert (f.levels(h)[level >= floor] >= level[level >= floor]).all()
    assert (f.levels(h)[level < floor] > 0).mean() < 0.1


@pytest.mark.parametrize("least", lm_filter.LEAST)
def test_quantised_counts_are_close(least):
    n = np.arange(least, 5000)
    q = lm_filter.count_of(lm_filter.levels_of(n, least), least)
    assert (np.abs(q - n) <= 0.25 * n).all() and (np.diff(q) >= 0).all()
    assert (lm_filter.levels_of(np.arange(least), least) == 0).all()


def test_a_filter_too_large_to_broadcast_loses_nothing(spark, odd_dir):
    """Asked block by block in the blocks' tasks, it gives the same scores as the broadcast one."""
    for path in (odd_dir, "/root/testdata/sf0.001"):
        docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
        rows = lambda **x: sorted(map(tuple, lm_filter.lm_scores(docs, **x).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "score").collect()), key=repr)
        small = rows(max_bytes=1)
        assert small == rows() and len(small) == docs.count()


def test_a_filter_in_blocks_is_asked_where_it_is_learned(spark, monkeypatch):
    """Beside its texts, a corpus asked by blocks moves its n-grams once, and no more rows than its runs and blocks make."""
    monkeypatch.setattr(lm_filter, "CHARS_A_BLOCK", 1 << 14)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(8).localCheckpoint()
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {s.stageId(): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in map(found.apply, range(found.size()))}

    def moved(**x):
        before = stages()
        rows = sorted(map(tuple, lm_filter.lm_scores(docs, **x).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "score").collect()), key=repr)
        own = [v for s, v in stages().items() if s not in before]
        return rows, sum(n for n, _ in own), sum(size for _, size in own)

    rows, n, size = moved(max_bytes=1)
    theirs, _, other = moved()
    assert rows == theirs
    assert n < 3 * 16 * 128  # 8 tasks, a run of each held out and one not; 128 blocks; asked and answered
    assert size < 1.6 * other
