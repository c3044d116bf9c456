"""Inputs of the registered queries, derived from the given tables.

The given texts hold Latin letters only, so they are transliterated letter by letter; the
target letters include every folded series, and frequent short words become stopwords.
Conversations become chats: the first turn is a message, later turns are replies, some of
them in a linked discussion chat.  Pages become analysis requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelscope.functions.once import with_computed
from fidelscope.functions.text import clean_text
from fidelscope.operators.features import fit_vocabulary
from fidelscope.operators.model import INTERCEPT, TextModel
from fidelscope.operators.sentences import non_blank
from fidelscope.session import stage

LATIN = "abcdefghijklmnopqrstuvwxyz"
FIDEL = "የደዐአምይገጣእጀኀለመናላፐከቀሰበተቸወፈሩዘ"
#: Words that no given text holds after transliteration.
UNKNOWN = "ቐቐ ቓቓ"
INTERCEPTS = {0: 0.05, 1: -0.02, 2: 0.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The given tables are single files of one split; their texts are dealt out to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def fidel(col: str | Column) -> Column:
    return F.translate(F.lower(col), LATIN, FIDEL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, lang, text`` with links, tags, symbols and foreign digits in front of some texts."""
    front = (
        F.when(
            F.col("lang") == "fr",
            F.concat(F.lit("https://ex.am/"), "doc_id", F.lit(" @"), "source", F.lit(" #fr ")),
        )
        .when(F.col("lang") == "de", F.lit("😂 ٣߂༥፣ www.ex.am 10.5% "))
        .when(F.col("lang") == "es", F.lit("ሀገር፡ሰው። "))
        .otherwise("")
    )
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return rows.select(F.col("doc_id").alias("id"), "lang", F.concat(front, fidel("text")).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled corpus ``id, text, label`` with codes as text."""
    label = F.when(F.col("toxic") == 1, "1").when(F.col("quality") == 0, "2").otherwise("0")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Dealt out behind the join, so only labelled texts are.
    joined = spread(docs.join(table(spark, sf_dir, "labels"), "doc_id"))
    return joined.select(
        F.col("doc_id").alias("id"), fidel("text").alias("text"), label.alias("label")
    )


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, processed, label`` of the non-blank corpus texts."""
    cleaned = with_computed(corpus(spark, sf_dir), processed=clean_text("text"))
    return non_blank(cleaned).select("id", "label", "processed")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, processed`` of all documents with something left after cleaning."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").alias("id"), fidel("text").alias("text"))
    return non_blank(with_computed(rows, processed=clean_text("text"))).select("id", "processed")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 10).alias("chat_id")
    ).distinct()
    chat = F.col("chat_id")
    linked = F.when(chat % 2 == 0, chat + 100)
    kind = F.when(chat % 5 < 3, "Channel").when(chat % 5 == 3, "Chat").otherwise("User")
    main = ids.select(
        chat.alias("chat_id"),
        F.concat(F.lit("chan"), chat).alias("username"),
        kind.alias("kind"),
        F.concat(F.lit("Chat "), chat).alias("title"),
        linked.alias("linked_chat_id"),
    )
    groups = ids.where(linked.isNotNull()).select(
        linked.alias("chat_id"),
        F.lit(None).cast("string").alias("username"),
        F.lit("Chat").alias("kind"),
        F.concat(F.lit("Talk "), chat).alias("title"),
        F.lit(None).cast("bigint").alias("linked_chat_id"),
    )
    quiet = ids.limit(1).select(
        F.lit(200).cast("bigint").alias("chat_id"), F.lit("quiet").alias("username"),
        F.lit("Channel").alias("kind"), F.lit("Quiet").alias("title"),
        F.lit(None).cast("bigint").alias("linked_chat_id"),
    )
    return main.unionByName(groups).unionByName(quiet)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    chat = conv % 10
    moved = (turn > 0) & (F.col("role") == "user") & (conv % 2 == 0)
    turns = spread(table(spark, sf_dir, "conversations"))
    # Beside all given turns: blank messages, some threads of unknown words, a channel of blanks.
    third, fifth = conv % 3 == 0, conv % 5 == 0
    more = F.filter(F.array(*(
        F.struct(
            F.when(keep, F.lit(place).cast("bigint") if place else chat).alias("chat_id"),
            (conv * 10 + number).alias("message_id"),
            (conv * 10 + reply if reply else F.lit(None).cast("bigint")).alias("reply_to"),
            F.lit(text).alias("text"),
        )
        for keep, place, number, reply, text in (
            (F.lit(True), 0, 9, 0, ""), (third, 0, 8, 0, UNKNOWN), (third, 0, 10_000_007, 8, UNKNOWN),
            (fifth, 200, 6, 0, ""),
        )
    )), lambda m: m["chat_id"].isNotNull())
    return turns.select(
        F.when(moved, chat + 100).otherwise(chat).alias("chat_id"),
        (conv * 10 + turn).alias("message_id"),
        F.when(turn > 0, conv * 10).alias("reply_to"),
        fidel("text").alias("text"),
    ).unionByName(turns.where(turn == 0).select(F.inline(more)))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that head a thread, with the linked chat of their channel."""
    linked = chats(spark, sf_dir).select(
        "chat_id", F.when(F.col("kind") == "Channel", F.col("linked_chat_id")).alias("linked_chat_id")
    )
    heads = messages(spark, sf_dir).where(F.col("reply_to").isNull())
    return heads.join(linked, "chat_id").select("chat_id", "message_id", "linked_chat_id", "text")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, url, message_limit``: every route, every error, every kind of limit."""
    kind, n = F.col("page_id") % 12, F.floor(F.col("page_id") / 12)
    chan, post = n % 10, n * 10
    url = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat(F.lit("https://t.me/chan"), chan))
        .when(kind == 2, F.concat(F.lit("https://t.me/c/"), n % 11))
        .when(kind == 3, F.concat(F.lit("http://telegram.me/Chan"), chan, F.lit("/?x=1")))
        .when(kind == 4, F.concat(F.lit("https://t.me/chan"), chan, F.lit("/"), post))
        .when(kind == 5, F.concat(
            F.lit("https://t.me/s/chan"), chan, F.lit("/"),
            post + F.when(n % 6 == 0, 8).when(n % 3 == 1, 9).otherwise(0), F.lit("#c")))
        .when(kind == 6, F.concat(F.lit("t.me/chan"), chan))
        .when(kind == 7, "")
        .when(kind == 8, F.concat(F.lit("https://t.me/chan"), chan, F.lit("?u=facebook.com/")))
        .when(kind == 9, F.concat(F.lit("https://t.me/c/"), F.lit("x"), chan))
        .when(kind == 10, F.concat(F.lit("https://www.foot.me/chan"), chan, F.lit(";p")))
        .when(n % 2 == 0, "https://t.me/quiet")
        .otherwise(F.concat(F.lit("https://t.me/lost"), n))
    )
    by_limit = F.col("page_id") % 7
    limit = (
        F.when(by_limit == 0, "all").when(by_limit == 1, "5").when(by_limit == 2, "ALL")
        .when(by_limit == 3, "12").when(by_limit == 4, "abc").when(by_limit == 5, "-5")
    )
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("request_id"), url.alias("url"), limit.alias("message_limit")
    )


def coefficient(term: Column, cls: Column) -> Column:
    """A fixed pseudo-random weight in [-1, 1) per term and class."""
    digest = F.md5(F.concat(term, F.lit(":"), cls.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") / F.lit(134217728.0) - 1


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of the labelled corpus: ``idx, term, df, cf, idf``."""
    return fit_vocabulary(stage(clean_corpus(spark, sf_dir)))


def coefficients(vocab: DataFrame) -> DataFrame:
    """``class, idx, term, coef`` for the three classes."""
    cls = F.explode(F.array(*map(F.lit, INTERCEPTS)))
    return vocab.select("idx", "term", cls.alias("class")).withColumn(
        "coef", coefficient(F.col("term"), F.col("class"))
    )


def model(spark: SparkSession, sf_dir: str) -> TextModel:
    """A model with the corpus vocabulary and the fixed weights."""
    vocab = vocabulary(spark, sf_dir).persist()
    intercepts = spark.createDataFrame(
        [(c, INTERCEPT, b) for c, b in INTERCEPTS.items()], "class INT, idx BIGINT, coef DOUBLE"
    )
    rows = coefficients(vocab).select("class", "idx", "coef").unionByName(intercepts)
    built = TextModel.from_tables(vocab, rows)
    vocab.unpersist()
    return built
