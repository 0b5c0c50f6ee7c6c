import random

from pyspark.sql import functions as F

from docquarry.functions import text as X


def clean(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(X.clean_text(F.col("t"))).collect()]


def test_page(spark):
    page = "\n".join([
        "Record of Changes", "2/20/25", "Maternity Benefit Waiting Period.......5-9", "Hospitalization Claim Filing Procedures",
        "5-1-13", "For more information see https://www.insurance.com/claims", "Pre-existing Disease Exclusions", "Page 12"])
    assert clean(spark, page, None, " \n ") == [
        "Hospitalization Claim Filing Procedures\n5-1-13\nFor more information see\nPre-existing Disease Exclusions", "", ""]


def test_hyphens(spark):
    assert clean(spark, "con-\nditions", "a-\nb-\nc", "| a  | b-\nnext", "- item-\nnext", "x-\n- y-\nz", "end-") == [
        "conditions", "abc", "| a | b-\nnext", "- item-\nnext", "x- yz", "end-"]


def test_columns(spark):
    long = "y" * 61
    assert clean(spark, "a  b", "a  b   c", f"a  b  {long}", "  • first  point") == ["a b", "| a | b | c |", f"a b {long}", "- first point"]


def test_other_lines(spark):
    assert clean(spark, "PROSPECTUS\nx", "January 5, 2024\nx", "____\nx", "12\nx", "ﬁne “q” − ’s") == ["x", "x", "x", "x", "fine \"q\" - 's"]


def stitch_loop(lines):
    out = []
    for line in lines:
        if out and out[-1][0].endswith("-") and out[-1][1]:
            out[-1] = (out[-1][0][:-1] + line, True)
        else:
            out.append((line, not line.startswith(("|", "- "))))
    return "\n".join(x for x, _ in out)


def test_hyphens_against_a_loop(spark):
    rng = random.Random(1)
    pool = ["a-", "b", "| t-", "- i-", "- j", "-", "| u |", "c-d-", "é-"]
    cases = [[rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(3000)]
    df = spark.createDataFrame([(i, "\n".join(c)) for i, c in enumerate(cases)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.join_hyphens(F.col("t"))).collect()]
    assert got == [stitch_loop(c) for c in cases]


def test_line_count(spark):
    texts = ["", "a", "a\n", "a\nb", "a\n\n", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(X.line_count(F.col("t"))).collect()] == [len(t.splitlines()) for t in texts]


def test_markdown_table(spark):
    df = spark.createDataFrame([(["h", "k"], [["a\nb", None]]), (["", " "], [["", None]])], "h array<string>, r array<array<string>>")
    assert [r[0] for r in df.select(X.markdown_table(F.col("h"), F.col("r"))).collect()] == ["| h | k |\n| --- | --- |\n| a b |  |", None]
