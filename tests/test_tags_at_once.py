"""All tags of a text at once against one after the other."""

import random

from pyspark.sql import functions as F

from cloakwork.functions.text import set_tag, set_tags, tag_values, values_of_tags
from cloakwork.rules import BLANK_TAGS, PSEUDO_TAGS


def texts(seed, n=150):
    r = random.Random(seed)
    tags = [*PSEUDO_TAGS, *BLANK_TAGS[:8], "patientNAME", "Other", "PatientNameé", "Ward"]
    for _ in range(n):
        out = []
        for _ in range(r.randint(0, 12)):
            t = r.choice(tags)
            out.append(r.choice([f"<{t}>", f"</{t}>", f'<{t} kind="a>b">', f"<{t}/>", "text\n", "$1 \\ x", f"<{t}>v</{t}>", f"<{t.upper()}>v</{t.lower()}>", "<", "><"]))
        yield "".join(out)


def test_equal_to_one_after_the_other(spark):
    df = spark.createDataFrame([(t,) for t in [None, "", *texts(1)]], "text string")
    value = F.lit("P$1\\_0001")
    one, other = F.col("text"), F.col("text")
    for t in PSEUDO_TAGS:
        one = set_tag(one, t, value)
    for t in BLANK_TAGS[:9]:
        other = set_tag(other, t, F.lit(""))
    rows = df.select("text", one.alias("a"), set_tags(F.col("text"), PSEUDO_TAGS, value).alias("b"), other.alias("c"), set_tags(F.col("text"), BLANK_TAGS[:9], F.lit("")).alias("d")).collect()
    assert all(x.a == x.b and x.c == x.d for x in rows) and sum(x.a != x.text for x in rows) > 50
    assert df.select(set_tags(F.col("text"), ["a-b", "Ward"], value).alias("x")).collect() == df.select(set_tag(set_tag(F.col("text"), "a-b", value), "Ward", value).alias("x")).collect()


def test_values_of_tags(spark):
    df = spark.createDataFrame([(t,) for t in ["", *texts(2)]], "text string")
    rows = df.select(F.flatten(F.array(*(tag_values(F.col("text"), t) for t in PSEUDO_TAGS))).alias("a"), values_of_tags(F.col("text"), PSEUDO_TAGS).alias("b")).collect()
    assert all(sorted(x.a) == sorted(x.b) for x in rows) and any(x.a for x in rows)
