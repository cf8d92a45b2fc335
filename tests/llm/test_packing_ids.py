"""The packing operator's ids against those of the whole tokenizer, over texts made to break short cuts."""

import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import packing, queries

ATOMS = """. ! ? , 's 'S 'll don't é É é ß ẞ Σ ΟΔΟΣ ſ ﬁ ǅ ŉ 42 7th שלום 中文 日本。 a.b x!y Ünïcode ÀÉ. İ İ. ½ ² ª º µ ÷ × word The ı Ÿ ÿ þ Đ Å 가 $ #tag @ -- ...
<|endoftext|> <|ENDOFTEXT|> <|startoftext|> <| |> ‍ ̀ ̇ \x00 \x1c \u0085     🙂 ٣""".split(" ") + [" ", "\n", "\t", "\r\n", " "]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


def strings(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    odd = [range(32, 127), range(160, 600), range(0x300, 0x370), range(0x1E00, 0x2100)]
    return ["".join(r.choice(ATOMS) if r.random() < 0.8 else chr(r.choice(r.choice(odd))) for _ in range(r.randrange(14))) for _ in range(n)]


def test_ids_of_random_strings(whole):
    texts = strings(20_000, 5)
    encode = packing.tokenizer(packing.vocabulary())
    for _ in range(2):  # the second time from the cache
        got = [x.tolist() for x in encode(pa.array(texts))]
        assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_cut_where_no_token_reaches(whole):
    text = " ".join(strings(500, 6)) + "x" * 300
    parts = packing._parts(text, 100)
    assert "".join(parts) == text and len(parts) > 10
    assert [k for p in parts for k in whole.encode(p, add_special_tokens=False).ids] == whole.encode(text, add_special_tokens=False).ids


def test_query_gives_each_piece_its_checksum(spark, whole, tmp_path):
    texts = [None, "", *strings(300, 7), " ".join(strings(4000, 8)), "<|ENDOFTEXT|> İ.", *["same text again"] * 50]
    rows = [(None if i % 9 == 8 else i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_packing(spark, str(tmp_path)).collect()
    want = {}
    for doc_id, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        want.setdefault(doc_id, []).append(ids)
    for x in out:
        assert any(len(ids) == x.doc_tokens and zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[x.start : x.start + x.length])) == x.ids_crc32 for ids in want[x.doc_id])
    assert sum(x.length for x in out) == sum(len(ids) for v in want.values() for ids in v)
    sequences = {}
    for x in out:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 2048 or at.bit_count() == 1


def test_equal_rows_are_dealt_over_ranges(spark):
    docs = spark.range(0, 400, numPartitions=2).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("one and the same text").alias("text"))
    out = packing.pack(docs, length=64, ranges=4)
    assert out.select(F.shiftright("sequence_id", 40).alias("r")).distinct().count() > 1
    assert out.agg(F.sum(F.octet_length("ids") / 4)).first()[0] == 400 * 6
