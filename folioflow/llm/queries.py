"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op1_ngram_join": oracle.NGRAM_JOIN, "op8_embedding_near_dedup": oracle.NEAR_EMBEDDINGS, "op13_collocations": oracle.COLLOCATIONS}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as binary token-id files, described from the files."""
    from folioflow.llm.token_files import encode_to_files

    return encode_to_files(documents(spark, sf_dir), vocabulary(), end_id=2)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 2048 ids, along a Hilbert curve."""
    from folioflow.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary(), end_id=1, length=2048)


@query
def op4_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored losslessly as baseline JPEG, and features read back from the stored bytes."""
    from folioflow.llm.jpeg import media_features

    return media_features(documents(spark, sf_dir))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every text."""
    from folioflow.llm.licenses import license_scan

    return license_scan(documents(spark, sf_dir))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base spans, and terms that reveal them."""
    from folioflow.llm.pii import find

    return find(documents(spark, sf_dir))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document so that sources meet their target shares."""
    from folioflow.llm.mixing import mix

    return mix(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text, learned from positive and unlabelled texts."""
    from folioflow.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by nearest centroids."""
    from folioflow.llm.langid import language_id

    return language_id(documents(spark, sf_dir, "doc_id", "text", "lang"))


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept rows of near-duplicate embeddings."""
    from folioflow.llm.embeddings import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word shingles overlap."""
    from folioflow.llm.ngram_join import join

    return join(documents(spark, sf_dir))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the word vocabulary, and whether they pass the limit."""
    from folioflow.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every text, and how often the linked ids are linked in the corpus."""
    from folioflow.llm.alignment import align

    return align(documents(spark, sf_dir), vocabulary(), vocabulary("piece_bpe_32k.model"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of two to five words that stand out most, by language."""
    from folioflow.llm.collocations import mine

    return mine(documents(spark, sf_dir, "lang", "text"))
