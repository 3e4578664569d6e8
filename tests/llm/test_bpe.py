import pytest
from pyspark.sql import functions as F

from lantern.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "   \n\n\t x  \r\n", "a'll we'VE don't  <|endoftext|> <|endoftext|>", "　x y \u0085 z\x1c\x1d q ", "=" * 300 + "ab" * 200, "日本語のテキスト" * 30,
    "👩‍🔧🔥 naïve façade é", "१२३ ٣٤ Ⅷ ½ x² 10,000.50", "word " * 4000, "hx-visit2-store timed out after 3139 ms; see AbstractRetryInterceptorFactoryBean.java:782", "Zürich Straße Ελληνικά русский العربية עברית ไทย 한국어",
    "antidisestablishmentarianism" * 20, "á́́ \U0001f1e9\U0001f1ea \x00 \x7f", "    indented\n\tcode = {x: 1}\n\n\n", "1" * 50, "!?!?!?... --- ***", "same same same Same SAME",
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library_and_back(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").withColumn("ids", bpe.encode(F.col("text"))).withColumn("back", bpe.decode(F.col("ids")))
    for r in df.collect():
        assert r.ids == reference.encode(r.text or "", add_special_tokens=False).ids, repr(r.text)
        assert r.back == (r.text or "")


def test_documents(spark, reference):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", bpe.encode(F.col("text")).alias("ids"))
    for r in df.collect():
        assert r.ids == reference.encode(r.text or "", add_special_tokens=False).ids


def test_words_that_are_tokens_encode_to_themselves(reference):
    """The short cut for whole words is exact: the merges of such a word end in its token."""
    import regex

    pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    for i, raw in bpe.vocabulary()["pieces"].items():
        text = raw.decode("utf-8", "ignore")
        if text.encode() == raw and pattern.findall(text) == [text]:
            assert reference.encode(text, add_special_tokens=False).ids == [i]


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "text string")
    assert df.select(bpe.encode(F.col("text"))).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").select(bpe.decode(F.col("ids"))).first()[0] is None


def test_count_is_the_length(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select(F.size(bpe.encode(F.col("text"))).alias("n"), bpe.count(F.col("text")).alias("m"))
    assert all(r.n == r.m for r in df.collect())


def test_kept_words_change_no_ids(spark, reference):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *TEXTS])], "i int, text string")
    kept = bpe.frequent_words(df, "text")
    assert kept and all(ids == reference.encode(w, add_special_tokens=False).ids for w, ids in kept.items()) and max(len(w.encode()) for w in kept) <= bpe.LONGEST_KEPT
    few = bpe.frequent_words(df, "text", most=3)
    assert len(few) == 3
    for k in (kept, few, {}):
        for r in df.select("text", bpe.encode(F.col("text"), kept=k).alias("ids")).collect():
            assert r.ids == reference.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.frequent_words(df.limit(0), "text") == {}
