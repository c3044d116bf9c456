import random
import unicodedata

import pytest
from pyspark.sql import functions as F

import restated
from fidelscope.functions import script, text

# Demo texts with their cleaned form and sentences.
DEMO = [
    ("ይህ በጣም ጥሩ ጽሑፍ ነው! https://example.com #አማርኛ #ጥሩ", "ጽሑፍ",
     ["ይህ በጣም ጥሩ ጽሑፍ ነው!", "https://example.com #አማርኛ #ጥሩ"]),
    ("እንዴት ነህ @abebew? የፖለቲካ ንግግር እና የጥላቻ ንግግር ልዩነት አለ።", "ነህ የዞለቲካ ንግግር የጥላቻ ንግግር ልዩነት",
     ["እንዴት ነህ @abebew?", "የፖለቲካ ንግግር እና የጥላቻ ንግግር ልዩነት አለ።"]),
    ("አንተ ደደብ ነህ:: ይህ የጥላቻ ንግግር ነው!!", "ደደብ ነህ የጥላቻ ንግግር",
     ["አንተ ደደብ ነህ::", "ይህ የጥላቻ ንግግር ነው!!"]),
    ("ይህ ጽሑፍ በዛሬው ዕለት ኅትመት ላይ ቀርቧል።", "ጽሑፍ በዛሬው እለት ህትመት ሀርቧል",
     ["ይህ ጽሑፍ በዛሬው ዕለት ኅትመት ላይ ቀርቧል።"]),
    ("😂 ሰላም ኁሉ! እናቴ እንዴት ነሽ?", "ሠላም ሁሉ ነሽ", ["😂 ሰላም ኁሉ!", "እናቴ እንዴት ነሽ?"]),
    ("  ይህ    ብዙ ክፍተቶች አሉት።   ", "ክፍተቶች", ["ይህ    ብዙ ክፍተቶች አሉት።"]),
    ("፨ በዛሬው ዕለት የኢትዮጵያ ዜና ታወቀ።", "በዛሬው እለት የኢትዮጵያ ዜና ታወሀ",
     ["፨ በዛሬው ዕለት የኢትዮጵያ ዜና ታወቀ።"]),
    ("እኔ 12345 ስልክ አለኝ። ٠٩٨٧٦٥٤٣٢١", "12345 ሥልክ አለኝ 0987654321",
     ["እኔ 12345 ስልክ አለኝ።", "٠٩٨٧٦٥٤٣٢١"]),
    ("ምንድነው የሰሩት? 🤷‍♀️ እጅግ በጣም ጥሩ!", "ምንድነው የሠሩት", ["ምንድነው የሰሩት?", "🤷‍♀️ እጅግ በጣም ጥሩ!"]),
    ("አማርኛ። ይህ የሙከራ ጽሑፍ ነው። በብዙ ዓረፍተ ነገሮች አማርኛ እየጻፍኩ ነው።",
     "አማርኛ የሙከራ ጽሑፍ በብዙ ኣረፍተ ነገሮች አማርኛ እየጻፍኩ",
     ["አማርኛ።", "ይህ የሙከራ ጽሑፍ ነው።", "በብዙ ዓረፍተ ነገሮች አማርኛ እየጻፍኩ ነው።"]),
    ("አንድ ብቻ ዓረፍተ ነገር.", "ኣረፍተ ነገር", ["አንድ ብቻ ዓረፍተ ነገር."]),
]
SPLITS = [
    ("a. b!! c", ["a.", "b!!", "c"]),
    ("10.5 ok. x:: y", ["10.5 ok.", "x::", "y"]),
    (". . .", [".", ".", "."]),
    ("a,b, c", ["a,b,", "c"]),
    ("x።ሰላም። ነው\nz;", ["x።ሰላም።", "ነው\nz;"]),
    ("end.\n", ["end."]),
    ("   ", []),
    (None, []),
]


def apply(spark, values, *exprs):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[1:] for r in sorted(frame.select("i", *exprs).collect())]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    pool = (
        list("እናሰቀዐፐኀላይጽሑፍምን ነው። 12 ") + list("http www @# .,;:?!\n\t ab_é")
        + [chr(c) for c in range(0x1200, 0x1380)]
        + [" ", " ", "፡", "።", "፨", "😂", "‌", "٣", "߂", "༥", "ﬁ", "Ａ", "\x1c"]
    )
    words = [*script.STOPWORDS, "http", "www.", "https://a.b/ሀ", "@ሰላም", "#x1"]
    return [
        "".join(rng.choice(words) if rng.random() < 0.2 else rng.choice(pool)
                for _ in range(rng.randint(0, 30)))
        for _ in range(n)
    ]


def test_demo_texts(spark):
    got = apply(spark, [d[0] for d in DEMO], text.clean_text("t"), text.split_sentences("t"))
    assert [tuple(g) for g in got] == [(c, s) for _, c, s in DEMO]


def test_split_edges(spark):
    got = apply(spark, [s for s, _ in SPLITS], text.split_sentences("t"))
    assert [g[0] for g in got] == [e for _, e in SPLITS]


def test_random_texts_match_the_rules(spark):
    values = random_texts(5000)
    cleaned = text.clean_text("t")
    got = apply(spark, values, cleaned, text.split_sentences("t"),
                text.feature_tokens(cleaned))
    for value, row in zip(values, got, strict=True):
        expected = restated.clean(value)
        assert row[0] == expected, repr(value)
        assert row[1] == restated.sentences(value), repr(value)
        assert row[2] == restated.feature_tokens(expected), repr(value)


def test_cleaning_is_idempotent(spark):
    frame = spark.createDataFrame([(t,) for t in random_texts(3000, 11)], "t string")
    once = frame.select(text.clean_text("t").alias("c"))
    assert once.where(text.clean_text("c") != F.col("c")).count() == 0


def test_steps_compose_to_the_fused_form(spark):
    stepwise = text.keep_script(text.strip_symbols(text.strip_mentions(text.strip_urls(
        text.normalize_chars(text.nfkc("t"))))))
    stepwise = F.array_join(text.drop_stopwords(text.tokens(stepwise)), " ")
    frame = spark.createDataFrame([(t,) for t in random_texts(3000, 3)], "t string")
    assert frame.where(stepwise != text.clean_text("t")).count() == 0


def test_nfkc_matches_unicodedata(spark):
    points = [chr(c) for c in range(1, 0x110000)
              if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    values = [f"a{''.join(points[i:i + 40])}b" for i in range(0, len(points), 40)]
    got = apply(spark, values, text.nfkc("t"))
    assert [g[0] for g in got] == [unicodedata.normalize("NFKC", v) for v in values]


def test_guard_and_options(spark):
    got = apply(spark, [None, "", "ሰው ቀን Été"], text.clean_text("t"),
                text.clean_text("t", normalize_stopwords=True),
                text.clean_text("t", profile="latin"))
    assert [tuple(g) for g in got] == [("", "", ""), ("", "", ""), ("ሠው ሀን", "", "Été")]


def test_no_python_in_the_plan(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(
        text.clean_text("t"), text.split_sentences("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("share", [0.125, 2.675, 1.005, 0.375, 33.333333, 100.0, 0.0])
def test_percentage_text_like_python(spark, share):
    from fidelscope.functions.labels import percentage_text

    row = spark.range(1).select(percentage_text(F.lit(share))).first()
    assert row[0] == f"{share:.2f}%"


def test_listed_tokens_are_dropped_in_order(spark):
    from fidelscope.operators.wordlists import drop_listed_tokens

    rows = [(1, ["b", "a", "b", "c", "a"]), (2, []), (3, None), (4, ["a", "a"]), (5, ["A", "d", None, "d"])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    words = spark.createDataFrame([("a",), ("a",), ("d",), (None,), ("zz",)], "word string")
    want = {1: ["b", "b", "c"], 2: [], 3: [], 4: [], 5: ["A", None]}
    for listed in (words, words.hint("shuffle_merge")):
        assert {r.id: r.tokens for r in drop_listed_tokens(docs, listed).collect()} == want


def test_guards_and_folding_give_the_steps_results(spark):
    texts = [
        None, "", "ቀሰ፡x😂٣߂", "@http://a.b ሀለ #ሐመ", "ሀhttpለ www", "#@ሀ", "ሀ።ለ ሐ፤መ", "htt@ሀp://x ሀ", "ﬁ ሀ ＠ሀ ｗｗｗ.ሀ ለሐ",
        " ሀ  ለ ", "እና ሀገር ለመ", "😀ዐ፥",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    listed = ["", *text.stopword_list()]
    steps = text.strip_mentions(text.strip_urls(F.translate(
        text.nfkc(F.coalesce("text", F.lit(""))), text._MAP_FROM, text._MAP_TO)))
    spaced = F.regexp_replace(steps, f"[^{text.script.SCRIPT_PROFILES['ethiopic']}]+", " ")
    plain = F.array_join(F.filter(F.split(spaced, " "), lambda t: ~t.isin(listed)), " ")
    both = rows.select(text.clean_text("text").alias("a"), plain.alias("b"), text.normalize_chars("text").alias("c"),
                       F.translate("text", text._MAP_FROM, text._MAP_TO).alias("d"))
    for r in both.collect():
        assert (r.a, r.c) == (r.b, r.d)
    assert "translate(" not in rows.select(text.clean_text("text"))._jdf.queryExecution().toString()
