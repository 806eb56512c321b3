import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyflow.llm import token_counts, token_files
from keyflow.llm.common import shared_dir
from keyflow.llm.encoders import Memo, spaced, words
from tests.llm.fixtures import documents, empty, rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "'s", "'LL", "é", "é", "́", "Σ", "ΑΣ", "1", "23", "!!", "<|endoftext|>",
    "<|startoftext|>", "漢", "👍🏽", "İ", "​", "᠎", "﻿", "\x00", "ÀB", "ß", "÷", "×", "'Ve", "<", "|>", "it's", "%%%", "_", "\r", "9é", "ª",
]


@pytest.mark.parametrize(("path", "cut"), [(WORD, words), (BYTE, spaced)])
def test_pieces_have_the_tokens_of_the_whole_text(path, cut):
    library, memo, rng = Tokenizer.from_file(path), Memo(path, list), random.Random(4)
    assert memo.plain is not None
    for _ in range(6000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        assert [i for x in cut(text) for i in memo[x]] == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_hold_all_ids(spark):
    path, docs = shared_dir(spark, "t"), documents(spark)
    token_files.write_tokens(docs, path, WORD)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()}
    library, at = Tokenizer.from_file(WORD), 0
    for key, text, *_ in sorted(rows()):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert found[key] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(found) == len(rows())


def test_files_are_orc_with_bloom_filters_and_prune(spark):
    path = shared_dir(spark, "t")
    token_files.write_tokens(documents(spark), path, WORD)
    one = token_files.read_tokens(spark, path).where("doc_id = 10")
    assert one.count() == 1
    assert "EqualTo(doc_id,10)" in one._jdf.queryExecution().executedPlan().toString()
    from pyarrow import orc

    local = spark.read.orc(f"{path}/ids").inputFiles()[0].removeprefix("file://")
    assert orc.ORCFile(local).compression.upper() == "ZSTD"


def test_bloom_filters_row_indexes_and_statistics_are_in_the_files(spark):
    """Read by the ORC library itself: streams of each stripe, encodings, strides, statistics, and stripes that a filter skips."""
    path = shared_dir(spark, "t")
    docs = spark.range(60_000).selectExpr("id * 2 AS doc_id", "concat('text ', id) AS text")
    token_files.write_tokens(docs.repartition(3), path, WORD)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    lows = []
    for file in spark.read.orc(f"{path}/ids").inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        names = list(reader.getSchema().getFieldNames())
        column = names.index("doc_id") + 1
        rows = reader.rows()
        for stripe, statistics in zip(reader.getStripes(), reader.getStripeStatistics(), strict=True):
            footer = rows.readStripeFooter(stripe)
            kinds = {x.getKind().toString() for x in footer.getStreamsList() if x.getColumn() == column}
            assert {"ROW_INDEX", "BLOOM_FILTER_UTF8", "DATA"} <= kinds
            ids = reader.getSchema().getChildren()[names.index("ids")].getChildren()[0].getId()
            assert footer.getColumns(ids).getKind().toString() == "DIRECT_V2"  # run-length encoding, version 2
            found = statistics.getColumnStatistics()[column]
            lows.append((found.getMinimum(), found.getMaximum()))
        rows.close()
    assert sorted(lows) == sorted(lows, key=lambda x: x[1]) and all(a[1] < b[0] for a, b in zip(sorted(lows), sorted(lows)[1:], strict=False))
    one = token_files.read_tokens(spark, path).where("doc_id = 41112").select("doc_id", "n_tokens")
    assert one.count() == 1 and token_files.read_tokens(spark, path).where("doc_id = 41113").count() == 0


def test_files_with_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "b"), (None, "c c"), (1, None)], "doc_id long, text string")
    path = shared_dir(spark, "t")
    token_files.write_tokens(docs, path, WORD)
    found = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 1, 1]
    assert [r.start for r in found] == [0, 3, *[3 + sum(x.n_tokens for x in found[1:k]) for k in (2, 3)]]


def test_files_of_an_empty_table(spark):
    path = shared_dir(spark, "t")
    token_files.write_tokens(empty(spark), path, WORD)
    assert token_files.checksums(token_files.read_tokens(spark, path)).count() == 0


def test_counts_are_the_librarys(spark):
    found = {r.doc_id: r for r in token_counts.token_counts(documents(spark), BYTE, shared_dir(spark, "c")).collect()}
    library = Tokenizer.from_file(BYTE)
    assert len(found) == len(rows())
    for key, text, *_ in rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[key].n_bytes, found[key].n_tokens, found[key].over_limit) == (len((text or "").encode()), n, n > 512)


def test_only_misses_are_encoded_and_stored_once(spark):
    cache = shared_dir(spark, "c")
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (None, None)], "doc_id long, text string")
    assert token_counts.token_counts(first, BYTE, cache).count() == 4
    assert spark.read.parquet(cache).count() == 3
    spark.read.parquet(cache).selectExpr("tokenizer", "digest", "n_tokens + 1000 AS n_tokens").write.parquet(cache + "-marked")
    more = first.unionByName(spark.createDataFrame([(4, "new text")], "doc_id long, text string"))
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, BYTE, cache + "-marked").collect()}
    assert found[1] >= 1000 and found[2] == found[1] and found[None] == 1000 and found[4] < 1000
    assert spark.read.parquet(cache + "-marked").count() == 4
    assert token_counts.token_counts(empty(spark), BYTE, cache).count() == 0


def test_a_filled_cache_is_read_and_nothing_encoded(spark):
    """A second run over all documents joins stored counts; another tokenizer's counts stay apart; digests stored twice count once."""
    cache, docs = shared_dir(spark, "c"), documents(spark)
    first = sorted(map(str, token_counts.token_counts(docs, BYTE, cache).collect()))
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert sorted(map(str, token_counts.token_counts(docs, BYTE, cache).collect())) == first
    assert spark.read.parquet(cache).count() == n
    stored.write.mode("append").parquet(cache + "-twice")
    stored.write.mode("append").parquet(cache + "-twice")
    assert sorted(map(str, token_counts.token_counts(docs, BYTE, cache + "-twice").collect())) == first
    token_counts.token_counts(docs, WORD, cache).count()
    assert spark.read.parquet(cache).count() == 2 * n and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
