"""Texts of 50 MB, and operators that cut long texts, against the same without cutting."""

import resource
import zlib

import numpy as np
import pytest

from colloquy.llm import suffix_dedup, tokens
from tests.llm import plain


def test_crc_of_parts():
    r = np.random.default_rng(1)
    for n, m in ((0, 0), (1, 0), (0, 5), (4, 4), (100, 1), (5, 70_000)):
        a, b = r.bytes(n), r.bytes(m)
        assert tokens.joined_crc(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_long_texts_are_cut_at_blanks(spark, monkeypatch, tmp_path):
    """Ids, starts and hashes are those of whole texts; no part holds more than one document."""
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(1, 9)))
    rows = [(k, " ".join(word() for _ in range(n))) for k, n in ((1, 30), (2, 900), (3, 5), (4, 2000), (5, 0), (7, 1200))] + [(6, "x" * 6000), (8, " " * 5000), (9, "end " + " " * 4000), (None, "a b " * 1000)]
    monkeypatch.setattr(tokens, "LONG_TEXT", 3000)
    monkeypatch.setattr(tokens, "PART_BYTES", 500)
    monkeypatch.setattr(tokens.bs, "PIECE", 2500)
    path = str(tmp_path / "shards")
    # workers have the module's own limits: write here what they would write with these
    import pyarrow as pa

    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    monkeypatch.setattr(tokens.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in order], pa.int64()), pa.array([x[1] for x in order])], ["doc_id", "text"])
    made = list(tokens._shards(tokens.default_tokenizer())(iter([batch])))
    assert sum(b.column(9)[0].is_valid for b in made) > 20
    spark.createDataFrame([b.to_pylist()[0] for b in made], tokens._SHARD).write.mode("overwrite").parquet(path)
    got = sorted((tuple(x) for x in tokens.read_tokens(spark, path).collect()), key=repr)
    assert got == sorted(plain.token_rows(order, tokens.default_tokenizer()), key=repr)


def test_pairs_of_large_symbols(monkeypatch):
    """Rules beyond 2^21 are paired on either side."""
    monkeypatch.setattr(tokens, "FIRST_RULE", (1 << 21) - 2)
    ids = np.tile(np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint32), 400)
    rules, lengths, seq, _ = tokens.compress(ids, np.array([len(ids)]))
    assert (tokens.expand(rules, lengths, seq) == ids).all() and lengths.max() >= 256
    assert (rules[:, 1] >= 1 << 21).any() and (rules[:, 0] >= 1 << 21).any()


def test_fifty_megabytes(tmp_path):
    """One text of 50 MB through the tasks of the token writer: memory grows by less than 1.5 GB."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from colloquy.llm import tokens
tokens.TaskContext.get = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())
r = np.random.default_rng(3)
words = np.array(["w%d" % k for k in range(60000)])
text = " ".join(words[(r.random(8_600_000) ** 3 * 60000).astype(int)])
assert len(text) > 48_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
batch = pa.RecordBatch.from_arrays([pa.array([5], pa.int64()), pa.array([text])], ["doc_id", "text"])
del text
n = sum(b.column(3)[0].as_py()[0] for b in tokens._shards(tokens.default_tokenizer())(iter([batch])))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    n, grown = done.stdout.split()
    assert int(n) > 8_000_000 and float(grown) < 1500
    assert resource.RUSAGE_SELF == 0


@pytest.mark.parametrize("block", [64, 3000, 20_000])
def test_large_anchors_are_split(spark, monkeypatch, block):
    """Boilerplate with running numbers: contexts under one anchor that differ beside it, cut again and again."""
    r = np.random.default_rng(4)
    base = "".join(r.choice(list("abcdefghij klm"), 420))
    rows = [(k, base[:150] + f"{k % 37:08d}" + base[150:300] + f"{k % 11:04d}" + base[300:]) for k in range(150)] + [(900, None), (901, "short")]
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect())) == sorted(plain.without_repeats(rows))


def test_split_windows_meet_under_the_same_anchor():
    """Equal windows of different contexts share anchor and group at every width; sub-contexts cover all windows once."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    core = r.integers(97, 107, 260).astype(np.uint8)
    texts = []
    for _ in range(40):
        t = r.integers(97, 107, 320).astype(np.uint8)
        t[30:290] = core
        texts += [(t.tobytes()[f : f + n + 199]) for *_, f, n in (x for y in suffix_dedup.anchors(t.tobytes()) for x in zip(*y))]
    for width in suffix_dedup.WIDTHS:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["row", "text"])
        seen, anchor_of = {}, {}
        for b in suffix_dedup._split_rows(width)(iter([batch])):
            for x in b.to_pylist():
                for p in range(x["first"], x["first"] + x["n"]):
                    assert (x["row"], p) not in seen
                    seen[x["row"], p] = True
                    window = texts[x["row"]][p : p + 200]
                    assert anchor_of.setdefault(window, x["anchor"]) == x["anchor"]
        assert len(seen) == sum(len(t) - 199 for t in texts)
