"""Column functions against Python's own behaviour."""

import random
import re

from pyspark.sql import functions as F

from tidelog.functions import levels, names, text


def apply(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


LINES = ["ERROR x", "errors_total warned", "warned", "Warning: disk", "warn", "information", "INFO ok", "debug info",
         "Debugger", "an error and a warning", "", "ınfo here", "preinfo info_x", "İnfo"]


def test_level_rules_stay_different(spark):
    def first(order):
        return [next((w for w in order if w in line.lower()), "none") for line in LINES]

    assert apply(spark, LINES, levels.level_by_substring) == first(["error", "warn", "info", "debug"])
    assert apply(spark, LINES, levels.level_in_merge) == first(["error", "warn", "debug", "info"])
    plain = [x for x in LINES if x.isascii()]
    chain = [("error", r"\berror\b"), ("warn", r"\bwarn"), ("debug", r"\bdebug\b"), ("info", r"\binfo\b")]
    want = [next((n for n, p in chain if re.search(p, x.lower())), "none") for x in plain]
    assert apply(spark, plain, levels.level_by_word) == want
    for level, pattern in {"error": r"\berror\b", "warning": r"\bwarn(ing)?\b", "debug": r"\bdebug\b",
                           "info": r"\binfo\b"}.items():
        want = [bool(re.search(pattern, x, re.I)) for x in LINES]
        assert apply(spark, LINES, lambda c: levels.matches_level(c, level)) == want
    assert levels.matches_level(F.lit("x"), "all") is None
    assert levels.matches_level(F.lit("x"), None) is None
    assert levels.matches_level(F.lit("x"), "fatal") is None


def test_filenames(spark):
    files = ["a__b__c__2024-01-01_00-00-00.log", "a__b___c__d.log", "one.log", "a__b.log", "a.b__c.d__e.log",
             "a__b__c__r.part2.log", "a__b__c__r.previous.log", "nosuffix__x", "a__.log"]
    pieces = ["a|b|c", "a|b|_c", "one", "a|b", "a.b|c.d|e", "a|b|c", "a|b|c", "nosuffix|x", "a|"]
    for default in ("", "—"):
        for i, key in enumerate(["ns", "pod", "container"]):
            want = [([*p.split("|"), default, default])[i] for p in pieces]
            assert apply(spark, files, lambda c: names.filename_parts(c, default)[key]) == want
    labels = {"one.log", "a__b.log", "nosuffix__x", "a__.log"}
    assert apply(spark, files, names.source_label) == [
        f if f in labels else {"a__b___c__d.log": "b/_c", "a.b__c.d__e.log": "c.d/e"}.get(f, "b/c") for f in files]
    assert apply(spark, ["a.log.log", "x.part1.log"], names.display_name) == ["a", "x.part1"]


def test_output_names(spark):
    df = spark.createDataFrame([(0,), (1,), (12,)], "part int")
    cols = [F.lit(x) for x in ("n", "p", "c", "r")]
    got = [r[0] for r in df.select(names.output_name(*cols, part=F.col("part"))).collect()]
    assert got == ["n__p__c__r.log", "n__p__c__r.part1.log", "n__p__c__r.part12.log"]
    assert df.select(names.output_name(*cols, previous=True)).first()[0] == "n__p__c__r.previous.log"
    got = [r[0] for r in df.select(names.part_filename(F.lit("x.log"), F.col("part"))).collect()]
    assert got == ["x.log", "x.part1.log", "x.part12.log"]


def test_run_names(spark):
    runs = ["2024-01-05_07-08-09", "x", "2024-13-01_00-00-00"]
    assert apply(spark, runs, names.run_date_label) == ["Jan 05, 2024  07:08", "—", "—"]
    assert apply(spark, ["archive_2024-01-05_07-08-09.tar.gz", "other"], names.archive_run) == [
        "2024-01-05_07-08-09", "other"]


def test_sort_key(spark):
    cases = {"2024-01-01T00:00:00Z x": "2024-01-01T00:00:00Z", "short x": "", "  at frame": "", "": "",
             "0123456789": "0123456789", "012345678": "", "a\tbcdefghijk l": "a\tbcdefghijk"}
    assert apply(spark, list(cases), text.sort_key) == list(cases.values())


def human(size):
    """Unit from the bit length: ten bits to a unit."""
    power = min(4, max(size.bit_length() - 1, 0) // 10)
    return "%.1f %s" % (size / (1 << 10 * power), ("B", "KB", "MB", "GB", "TB")[power])


def test_human_size(spark):
    rng = random.Random(1)
    sizes = [0, 1, 1023, 1024, 1075, 1126, 1048575, 1048576, 2**40 - 1, 2**40, 2**50, 2**62]
    sizes += [rng.randrange(2 ** rng.randrange(1, 55)) for _ in range(4_000)]
    sizes += [1024 * k + 51 for k in range(100)] + [int(1024 * (k + 0.25)) for k in range(200)]
    assert apply(spark, sizes, text.human_size, "bigint") == [human(s) for s in sizes]


def test_text_search_takes_wildcards_only_when_asked(spark):
    values = ["100% sure", "1000 sure", "a_b", "axb", "ÉTÉ", "back\\slash"]
    assert apply(spark, values, lambda c: text.contains_text(c, "0% S")) == [True, False, False, False, False, False]
    assert apply(spark, values, lambda c: text.like_text(c, "A_B")) == [False, False, True, True, False, False]
    assert apply(spark, values, lambda c: text.contains_text(c, "été"))[4]
    assert apply(spark, values, lambda c: text.like_text(c, "k\\s"))[5]
