import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.parse_ranks(bpe.read_rank_file(PATH))
OWN = bpe.Codec(RANKS, public_tokenizers.PATTERN)
COUNTS = token_counts.counter(bpe.read_rank_file(PATH), public_tokenizers.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(st.one_of(st.sampled_from("ab  \n\tthe'sé9!😀"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_same_ids_as_library_and_round_trip(text):
    ids = OWN.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIB.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, " " * 5_000 + "x", "<|endoftext|>", "\n\n \n"])
def test_long_runs(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == LIB.encode_ordinary(text)


@settings(max_examples=600, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 8), TEXT.map(lambda x: x[:6])), max_size=4))
def test_counts_after_edits(text, raw):
    edits, at = [], 0
    for start, length, new in sorted(raw):
        start, end = min(start, len(text)), min(start + length, len(text))
        if start >= at:
            edits.append((start, end, new))
            at = end
    counted = token_counts.CountedText.stored(*token_counts.CountedText.of(text, COUNTS).row())
    assert counted.tree.total() == len(LIB.encode_ordinary(text))
    after = counted.edit(edits, COUNTS)
    expected = text
    for start, end, new in reversed(edits):
        expected = expected[:start] + new + expected[end:]
    assert after == expected
    assert counted.tree.total() == len(LIB.encode_ordinary(after))
    assert counted.edited(after).row() == token_counts.CountedText.of(after, COUNTS).row()


@given(st.lists(st.integers(0, 9), max_size=40))
def test_sums(leaves):
    tree = token_counts.SumTree.of(np.array(leaves, np.int64))
    assert tree.total() == sum(leaves)
    for i in range(len(leaves)):
        tree.put(i, leaves[i] * 2 + 1)
    assert tree.total() == 2 * sum(leaves) + len(leaves)
    assert tree.node[1:].tolist() == token_counts.SumTree.of(tree.leaves().copy()).node[1:].tolist()


def test_masks():
    text = "a@b 12345 x.y@z-1.co.uk, 99999@1.com @@ q@w.e@r.t 1234 a@b.c12345"
    edits = token_counts.mask_private(text)
    assert [text[a:b] for a, b, _ in edits] == ["12345", "x.y@z-1.co.uk", "99999@1.com", "q@w.e", "a@b.c12345"]


def test_edit_touches_little():
    text = "one two three " * 5_000
    counted = token_counts.CountedText.of(text, COUNTS)
    after = counted.edit([(30_000, 30_003, "four five")], COUNTS)
    assert counted.tree.total() == len(LIB.encode_ordinary(after))
    assert counted.n_reencoded() < 12


def test_stored_trees_are_edited_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (2, "x"), (None, "no id"), (4, ""), (5, "as it is")], "doc_id long, text string")
    token_counts.build_trees(docs, PATH, public_tokenizers.PATTERN).write.parquet(f"{tmp_path}/0")
    rounds = [
        [(1, 4, 7, "2"), (1, 0, 0, "zero "), (2, 0, 0, "y z "), (4, 0, 0, "no longer empty"), (9, 0, 1, "none"), (None, 0, 1, "?"), (5, None, 1, "?")],
        [(1, 5, 8, None), (4, 2, 9, ""), (2, 0, 1, "12345")],
    ]
    for i, edits in enumerate(rounds):
        trees = spark.read.parquet(f"{tmp_path}/{i}")
        table = spark.createDataFrame(edits, "doc_id long, start int, end int, new string").withColumn("text", bpe_extra())
        token_counts.apply_edits(trees, PATH, public_tokenizers.PATTERN, table).write.parquet(f"{tmp_path}/{i + 1}")
    rows = spark.read.parquet(f"{tmp_path}/2").collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, "no id"), (1, "zero  2 three"), (2, "12345 z "), (2, "12345 z x"), (4, "no empty"), (5, "as it is")]
    for r in rows:
        own = token_counts.CountedText.of(r.text, COUNTS)
        assert (r.text, bytes(r.ends), bytes(r.nodes)) == own.row()
        assert r.n_tokens_after == own.tree.total() == len(LIB.encode_ordinary(r.text)) and r.n_chars_after == len(r.text)
    assert {r.doc_id: r.n_reencoded for r in rows}[5] == 0
    with pytest.raises(Exception, match="overlaps"):
        bad = spark.createDataFrame([(1, 0, 5, ""), (1, 3, 6, "")], "doc_id long, start int, end int, new string")
        token_counts.apply_edits(spark.read.parquet(f"{tmp_path}/2"), PATH, public_tokenizers.PATTERN, bad).collect()


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello world 12345"), (2, None), (3, ""), (1, "Hello world 12345")], "doc_id long, text string").withColumn("ids", bpe_extra())
    rows = sorted(map(tuple, bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()))
    ids = LIB.encode_ordinary("Hello world 12345")
    assert rows[0] == rows[1] == (1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"Hello world 12345").hexdigest())
    assert rows[2][1] == rows[3][1] == 0
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in back) == [(1, b"Hello world 12345"), (1, b"Hello world 12345"), (2, b""), (3, b"")]
    counts = {r.doc_id: r for r in token_counts.count_with_edits(df, PATH, public_tokenizers.PATTERN).collect()}
    assert counts[1].n_tokens_after == len(LIB.encode_ordinary("Hello world <number>"))
    assert counts[2].n_tokens == counts[3].n_tokens_after == 0
    assert token_counts.count_with_edits(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def bpe_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_rank_file_is_read(tmp_path):
    f = tmp_path / "r"
    f.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert len(bpe.parse_ranks(bpe.read_rank_file(str(f)))) == 256
