import random
from fractions import Fraction

from pyspark.sql import functions as F

from glyphmill.functions import equations
from glyphmill.functions import text as t


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
    return row[-1]


def alignments(a, b):
    """Every alignment of two strings, its steps from the last to the first."""
    if not a and not b:
        yield ""
    if a and b:
        yield from (("=" if a[-1] == b[-1] else "s") + rest for rest in alignments(a[:-1], b[:-1]))
    if a:
        yield from ("d" + rest for rest in alignments(a[:-1], b))
    if b:
        yield from ("i" + rest for rest in alignments(a, b[:-1]))


def preferred(a, b):
    """The cheapest alignment that, read from its end, takes both sides where it can, then drops, then adds."""
    return min(alignments(a, b), key=lambda x: (len(x) - x.count("="), x.translate(str.maketrans("=sdi", "0012"))))[::-1]


def test_scores_of_known_pairs(spark):
    rows = [("a", "b"), ("aaaaaaa", "aaaaaaa"), ("kitten sits", "sitting kits"), ("x  y", " x y "), ("", "x"), (None, "x"), ("é", "e")]
    got = spark.createDataFrame(rows, "r string, p string").select("r", "p", t.score(F.col("p"), F.col("r")).alias("m")).collect()
    m = [x.m for x in got]
    assert (m[0].char_edits, m[0].reference_chars, m[0].cer, m[0].wer) == (1, 1, 1.0, 1.0)
    assert m[1].exact_match and m[1].cer == 0
    assert m[2].char_edits == distance("kitten sits", "sitting kits") and m[2].word_edits == 2
    assert m[3].exact_match and m[3].raw_cer > 0
    assert m[4] is None and m[5] is None
    assert m[6].char_edits == 1


def test_distances_against_an_independent_one(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 3)))
    pairs = [(" ".join(word() for _ in range(r.randrange(1, 9))), " ".join(word() for _ in range(r.randrange(1, 9)))) for _ in range(150)]
    got = spark.createDataFrame(pairs, "r string, p string").select("r", "p", t.score(F.col("p"), F.col("r")).alias("m")).collect()
    for x in got:
        assert x.m.char_edits == distance(x.r, x.p)
        assert x.m.word_edits == distance(x.r.split(), x.p.split())


def test_white_space_is_the_same_inside_the_step(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    rows = spark.createDataFrame([(chr(c), f"{chr(c)}a{chr(c)}b ") for c in codes], "c string, x string")
    got = rows.select("c", "x", t.normalize_text(F.col("x")).alias("n"), t.has_text(F.col("c")).alias("h")).collect()
    assert [r.c for r in got if " ".join(r.x.split()) != r.n or r.h == r.c.isspace()] == []


def test_sizes_and_missing_texts(spark):
    rows = [("a  bc\u2003d ", None), ("", "x"), (None, "x"), (" \n", " "), ("a b", "a\tb"), ("a b", "ab")]
    got = spark.createDataFrame(rows, "r string, p string").select(t.sizes("r").alias("n"), t.edits("r", "p").alias("e"), t.has_text(F.col("r")).alias("h")).collect()
    assert [tuple(x.n) for x in got] == [(6, 3), (0, 0), (None, None), (0, 0), (3, 2), (3, 2)]
    assert [tuple(x.e) for x in got] == [(None, None, 6, 3, None), (1, 1, 0, 0, False), (None,) * 5, (0, 0, 0, 0, True), (0, 0, 3, 2, True), (1, 2, 3, 2, False)]
    assert [x.h for x in got] == [True, False, None, False, True, True]


def test_word_codes_beyond_two_bytes(spark):
    codes = spark.range(1).select(*[F.length(F.decode(F.unhex(F.lit(f"{c:08X}")), "UTF-32")).alias(f"c{c}") for c in (0x100, 0xD7FF, 0xE000, 0x10000, 0x10FFFF)]).first()
    assert set(codes) == {1}


def test_edit_steps(monkeypatch):
    monkeypatch.setattr(t, "STRIDE", 2)
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in "ab")
        assert t.edit_steps(a, b) == preferred(a, b)
    monkeypatch.setattr(t, "STRIDE", 4)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(30))) for _ in "ab")
        steps = t.edit_steps(a, b)
        assert len(steps) - steps.count("=") == distance(a, b)
        assert len(steps) - steps.count("i") == len(a) and len(steps) - steps.count("d") == len(b)


def test_pairs_without_a_table(monkeypatch):
    """Replacements alone, and parts left out on one side, cost no cost rows."""
    monkeypatch.setattr(t, "_rows", None)
    a = "the sea, the tent and the theme " * 40
    for b in (a.replace("e", "c"), a.replace(" the ", " "), "x " + a + " x", ""):
        for left, right in ((a, b), (b, a)):
            steps = t.edit_steps(left, right)
            assert len(steps) - steps.count("=") == t.edit_distance(left, right)
            assert len(steps) - steps.count("i") == len(left) and len(steps) - steps.count("d") == len(right)
            assert t.edit_distance(left.split(), right.split()) <= t.edit_distance(left, right)


def test_edits_of_all_kinds(monkeypatch):
    monkeypatch.setattr(t, "STRIDE", 3)
    r = random.Random(7)
    for k in range(400):
        a = "".join(r.choice("abc") for _ in range(r.randrange(12)))
        b = ["".join(c for c in a if r.random() < 0.7), a.replace("a", "x"), a.replace("a", "bb"), a[3:] + a[:3]][k % 4]
        for left, right in ((a, b), (b, a)):
            assert t.edit_distance(left, right) == distance(left, right) == t.edit_distance(list(left), list(right))
            if len(left) < 7 and len(right) < 7:
                assert t.edit_steps(left, right) == preferred(left, right)


def test_alignment_cap(spark):
    long = "x" * 600
    got = spark.createDataFrame([("ab", "ac"), (long, long + "y"), (None, "a")], "r string, p string").select(t.edit_alignment("r", "p").alias("a")).collect()
    assert [(x.a.status, x.a.steps) for x in got] == [("available", "=s"), ("omitted_cell_limit", None), (None, None)]


def test_flags(spark):
    rows = [("", False), ("a a a", True), ("one two one two", False), ("Here is the text", False), ("fine words", False), (None, False)]
    got = [x.f for x in spark.createDataFrame(rows, "p string, t boolean").select(t.flags(F.col("p"), F.col("t")).alias("f")).collect()]
    assert got == [["empty_output"], ["truncated", "repeated_text"], ["repeated_text"], ["extra_commentary"], [], ["empty_output"]]


def test_label_issues(spark):
    rows = [("a {b}", "prose"), ("}{", "prose"), ("$x", "prose"), ("$x", "equation"), (" ", "other"), ("TODO", "prose")]
    got = [x.f for x in spark.createDataFrame(rows, "p string, k string").select(t.label_issues(F.col("p"), F.col("k")).alias("f")).collect()]
    assert got == [[], ["unbalanced_latex_braces"], ["unbalanced_inline_math"], [], ["empty_reference", "unknown_content_type"], ["unresolved_label"]]


def test_normal_forms(spark):
    odd = "a  b\x1cc​d"
    got = spark.createDataFrame([(odd, "é, x!")], "a string, b string").select(t.normalize_text(F.col("a")).alias("a"), t.normalize_content(F.col("b")).alias("b")).first()
    assert got.a == "a b c​d" and got.b == "éx"


def test_equations():
    assert equations.compare("(x+1)^2", "x^2+2*x+1")[0] == "equivalent"
    assert equations.compare("x^2", "x", {"x": [0, 1]})[0] == "undetermined"
    assert equations.compare("x^2", "x", {"x": [2]}) == ("different", "numeric_counterexample", "x=2: 4 <> 2")
    assert equations.compare("x/0", "x/0")[0] == "undetermined"
    assert equations.compare("0^0", "0^0")[0] == "undetermined"
    assert equations.compare("", "x")[1] == "empty_expression"
    assert equations.compare("x^2", "x")[1] == "domain_missing"
    assert equations.compare("__import__('os')", "x")[0] == "undetermined"
    assert equations.compare("1/x", "1/x")[0] == "equivalent"
    assert equations.compare("x", "x+1", {"x": list(range(513))})[1] == "domain_limit"
    assert equations.compare("x", "x+1", {"x": [None, True, float("nan"), "?"]})[1] == "domain_missing"
    assert equations.compare("0^0", "2")[0] == "undetermined" and equations.compare("True", "1")[0] == "undetermined"
    assert equations.compare("(x + y)^12", "(x + y)^12")[0] == "equivalent" and equations.compare("(x + y)^12", "x^12 + y^12")[0] == "undetermined"
    assert equations.compare("-" * 29 + "x", "-x")[0] == "equivalent" and equations.compare("-" * 30 + "x", "x")[1] == "expression too deep"
    assert equations.compare("1e400", "1")[0] == equations.compare("2", "10^18*10^18")[0] == "undetermined"


def test_equations_against_values():
    """Of random expressions those said to be equivalent have equal values, and those said to differ a point where they don't."""
    r = random.Random(3)

    def grown(depth):
        if not depth or r.random() < 0.2:
            return r.choice(["x", "y", str(r.randrange(4))])
        if r.random() < 0.15:
            return f"(-{grown(depth - 1)})"
        op = r.choice("+-*/^")
        return f"({grown(depth - 1)}{op}{r.randrange(3) if op == '^' else grown(depth - 1)})"

    def value(text, **at):
        try:
            return eval(text.replace("^", "**"), {k: Fraction(v) for k, v in at.items()})  # noqa: S307
        except ZeroDivisionError:
            return None

    seen = set()
    for _ in range(3000):
        a, b = grown(3), grown(2)
        status, _, _ = equations.compare(a, b, {"x": [-2, 1, 3], "y": [0, 5]})
        points = [(value(a, x=x, y=y), value(b, x=x, y=y)) for x in (-2, 1, 3) for y in (0, 5)]
        pairs = [(u, v) for u, v in points if u is not None and v is not None]
        seen.add(status)
        if status == "equivalent":
            assert all(u == v for u, v in pairs)
        elif status == "different":
            assert any(u != v for u, v in pairs)
    assert len(seen) == 3


def test_error_flags(spark):
    rows = [
        ("the cat", "the cat", "success", False), ("The Cat", "the cat", "success", False), ("the cat", "the dog", "success", True), ("", "x", "success", False), (None, "x", "error", None),
        ("ok", "ok", "error", False), ("кот", "cat", "success", False), ("a" * 33, "abcd", "success", False), ("no no no", "x", "success", False), ("Transcription: x", "x", "success", False), ("the  cat ", "the cat", None, False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, r string, s string, t boolean")
    got = {x.i: x.f for x in df.select("i", t.error_flags(F.col("r"), F.col("p"), F.col("s"), F.col("t")).alias("f")).collect()}
    assert got == {
        0: ["exact_match"], 1: ["case_only"], 2: ["truncated"], 3: ["empty_output"], 4: ["empty_output", "request_failure_or_missing"], 5: ["request_failure_or_missing"],
        6: ["non_latin_output"], 7: ["possible_extra_content"], 8: ["repeated_text"], 9: ["extra_commentary"], 10: ["request_failure_or_missing"],
    }


def test_equations_as_text(spark):
    df = spark.createDataFrame([(" é  = 1 ", "é = 1"), ("x", " "), (None, "x")], "p string, r string")
    assert [r.n for r in df.select(t.normalize_equation(F.col("p")).alias("n")).collect()] == ["é = 1", "x", None]
    got = [r.m for r in df.select(t.nfc(F.col("p")).alias("p"), t.nfc(F.col("r")).alias("r")).select(t.score_equation(F.col("p"), F.col("r")).alias("m")).collect()]
    assert got[0].equation_cer == 0 and got[0].normalized_exact_match and got[1] is None


def test_row_error_rates_fall_back(spark):
    rows = [("ab", "abcd", 0.9), ("x" * 600, "y" * 600, 0.25), ("x" * 600, "y" * 600, -1.0), ("x" * 600, "y" * 600, float("nan")), ("a", " ", 0.5), ("a", " ", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, r string, s double")
    got = [x.v for x in df.orderBy("i").select(t.row_error_rate(F.col("s"), F.col("p"), F.col("r")).alias("v")).collect()]
    assert got == [0.5, 0.25, None, None, 0.5, None]


def test_names_for_files(spark):
    names = ["Été 2_x!", "--", "a" * 60, "Ⅷ ½"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(t.safe_name(F.col("n")).alias("s")).collect()]
    assert [g.rsplit("-", 1)[0] for g in got] == ["été-2-x", "condition", "a" * 48, "ⅷ-½"] and all(len(g.rsplit("-", 1)[1]) == 8 for g in got)
