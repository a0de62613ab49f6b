import hashlib
import re

from taproom.llm import fill_middle

SCHEMA = "doc_id long, text string, n int, form string, output string"
TEXTS = [
    "plain words here", "", None, "a", "é😀𝒳 z", "line\nbreak\r\n end\n", "has <S> inside", "has <P", "ends <", "$1 \\2 \\E \\Q $",
    "x" * 255, "y" * 256, "z😀" * 256, "w" * 70_001, "S><M", "\n", " \t ", "́́", "same", "same",
]


def brute(doc, text, unit=None, seed=1, rate=90, first=20, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = list(text) if unit is None else re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < first:
        return doc, len(units), "spm", a, b - a, f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return doc, len(units), "psm", a, b - a, f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, "x", "y") for d, t in rows], SCHEMA)


ROWS = [(100 * i + j if i else None, t) for i in range(6) for j, t in enumerate(TEXTS)] + [(201, "a b"), (201, "other")]


def test_matches_slices_of_code_points(spark):
    got = fill_middle.fill_in_middle(frame(spark, ROWS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(*r) for r in ROWS), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back(spark):
    made = fill_middle.fill_in_middle(frame(spark, [r for r in ROWS if r[0]]), rate=100)
    back = made.select("doc_id", fill_middle.restored(made.output, made.form).alias("text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d, t or "") for d, t in ROWS if d), key=repr)


def test_other_units_rates_and_sentinels(spark):
    words, marks = r"\S++\s*+|\s++", ("$pre\\", "[suf]", "(mid)")
    rows = [(i, t) for i, t in enumerate(["one two  three\nfour", "  lead", "$pre\\", "a (mid) b", "w " * 999, "x"] * 5)]
    made = fill_middle.fill_in_middle(frame(spark, rows), unit=words, seed=7, rate=95, suffix_first=50, sentinels=marks)
    want = [brute(d, t, r"\S+\s*|\s+", 7, 95, 50, marks) for d, t in rows]
    assert sorted(map(tuple, made.collect())) == sorted(want)
    back = made.select("doc_id", fill_middle.restored(made.output, made.form, marks)).collect()
    assert sorted(map(tuple, back)) == rows


def test_empty_table_and_plan_without_python_or_shuffle(spark):
    made = fill_middle.fill_in_middle(frame(spark, []))
    assert made.collect() == [] and made.columns == ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
