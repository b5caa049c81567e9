"""Rules of the page conversion are skipped only where they would change nothing."""

import random

from pyspark.sql import functions as F

from docketframe.functions import html as H


def test_skipped_rules_would_not_match(spark):
    rng = random.Random(5)
    tags = "b strong i em h1 h6 hr br tr td th dt dd blockquote p div pre script style head a span".split()
    parts = [f"{start}{tag.upper() if rng.random() < 0.4 else tag}{end}" for tag in tags for start in ("<", "</") for end in (">", " x>", " >", "/>", "")]
    parts += ["<", ">", "x", " ", "  ", "\n", "\n\n\n", "<!--", "-->", H.NEW_LINE, H.SPACE, H.QUOTE]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(4000)] + [(-1, None)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(4)
    for rules in (H.HIDDEN, H.INLINE, H.BLOCKS):
        plain = F.col("text")
        for pattern, replacement, _ in rules:
            plain = F.regexp_replace(plain, pattern, replacement)
        assert texts.where(~H.replaced(F.col("text"), rules).eqNullSafe(plain)).collect() == []
    for text in (("a  b\tc"), "a b", "\r\nx"):
        row = spark.createDataFrame([(text,)], "text string").select(H.single_spaces(F.col("text")))
        assert row.first()[0] == " ".join(text.replace("\r\n", " ").split(" ")).replace("  ", " ").replace("\t", " ")
