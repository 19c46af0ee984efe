"""Hand-made golden cases for text, dates and shifts."""

import datetime as dt
import random
import unicodedata

from pyspark.sql import functions as F

from tixpark.functions import dates, text
from tixpark.operators import assign, dimensions, labels


def _one(spark, col_expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(col_expr(F.col("x"))).collect()]


def test_fold_ascii_latin1(spark):
    out = _one(spark, text.fold_ascii, ["¼ ½ ª º ß ñ Á", "Garantías."])
    assert out == ["14 12 a o  n A", "Garantias."]


#: Greek with stacked marks, Cyrillic, Vietnamese, Hangul letters, full-width forms, ligatures, units, marks out of order.
SCRIPTS = ["\u0391\u0301\u0345 \u1f80", "\u0418\u0306 \u0439 \u0401", "Vie\u0323\u0302t Na\u0300m ti\u1ebfng", "\u1112\u1161\u11ab\u1100\u1173\u11af \ud55c",
           "\uff21\uff22\uff23\u3000\uff11\uff12", "\ufb01n \u2460 \u247d \u33a5 \u2122", "a\u0301\u0323 a\u0323\u0301", "\u2003wide\u2028blank\u00a0", "\U0001d400\U0001d7d8 x",
           "plain", "Garant\u00edas \u00bd \u00aa", "", " \t "]


def test_normal_forms_of_any_script(spark):
    want = [" ".join(unicodedata.normalize("NFKC", x.strip().lower()).split()) for x in SCRIPTS]
    assert _one(spark, text.normalize_nfkc, [*SCRIPTS, None]) == [*want, ""]
    assert _one(spark, text.fold_ascii, [*SCRIPTS, None]) == [*map(text.fold_py, SCRIPTS), None]


def test_fold_of_every_code_point(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c))]
    assert _one(spark, text.fold_ascii, chars) == [text.fold_py(x) for x in chars]
    rare = set(text._RARE)
    keys = [x for x in chars if ord(x) not in rare]
    assert _one(spark, lambda c: text.to_column(c, text.FOLD_STEPS), keys) == [text.fold_py(x) for x in keys]


def test_clean_text(spark):
    out = _one(spark, text.clean_text, ["Error en la cuenta 12345 ws0067 de Juan, ok!", None])
    assert out == ["error cuenta juan", ""]


def test_mask_and_boilerplate(spark):
    raw = "Buenos días, por favor su ayuda con el reporte www.x.com 12/05/2024 1234567 aaaa. Saludos"
    m = _one(spark, text.mask_entities, [raw])[0]
    assert m == "buenos dias por favor su ayuda con el reporte url fecha num largo saludos"
    b = _one(spark, lambda c: text.strip_boilerplate(text.mask_entities(c)), [raw])[0]
    assert b == "el reporte url fecha num largo"


#: Pieces that the chains look for, alone, side by side and broken, in several scripts.
PIECES = ["Estimados", "buenos  d\u00edas", "por favor", "su gentil", "ayuda con", "quedo atento", "x@y.com", "a.b-c@d.e_f.g", "https://a.b/c?d=1", "www.x.y",
          "12/3/2020", "1234567", "123", "ab1", "1ab", "Ab1c", "aaaaa", "AAAA", "!!!!", "____", "\ufb01n", "\u2103", "\ud55c", "\u0130STANBUL", "\u03a3", "\u00df",
          "\u1d2c\u1d2c", "\u00a0", "\x1c", "\x85", "\u2028", "\u00bd kg", "con el", "para", "de la", "\n", "\r\n", "\t", "saludos cordiales", "gracias", "de antemano",
          "a a a a", "-", "/", "@", ".", "1-2-20", "espero se encuentren bien", "el", "m\u00e1s", "\U0001f600"]


def test_whole_text_chains_do_what_their_steps_say(spark):
    r = random.Random(3)
    rows = [None, "", *SCRIPTS, *("".join(r.choice(PIECES) + r.choice(["", " ", "  "]) for _ in range(r.randint(1, 20))) for _ in range(400))]
    given = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, x string")
    x = F.coalesce("x", F.lit(""))
    masked = text.to_column(F.regexp_replace(text.to_column(x, text.MASK_STEPS_HEAD), r"(.)\1{3,}", " "), text.MASK_STEPS_TAIL)
    cleaned = text.remove_stopwords(text.to_column(x, text.CLEAN_STEPS))
    blanks = F.size(F.filter(F.split(x, text.WS + "+"), lambda t: t != ""))
    plain = given.select("i", masked.alias("m"), cleaned.alias("c"), blanks.alias("n")).select("*", text.to_column(F.col("m"), text.BOILER_STEPS).alias("b"))
    out = given.select("i", text.mask_entities(F.col("x")).alias("m"), text.clean_text(F.col("x")).alias("c"), text.tokens_count(F.col("x")).alias("n"),
                       text.strip_boilerplate(text.mask_entities(F.col("x"))).alias("b"))
    assert out.orderBy("i").collect() == plain.orderBy("i").collect()


def test_whole_texts_are_not_built_anew_by_chains_of_expressions(spark):
    d = spark.createDataFrame([("a",)], "x string")
    for f in (text.mask_entities, text.clean_text, text.normalize_nfkc, lambda c: text.strip_boilerplate(text.mask_entities(c))):
        plan = d.select(f(F.col("x")))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "regexp_replace" not in plan and "replace(" not in plan


def test_choose_text(spark):
    df = spark.createDataFrame([("uno dos tres", "a b c d"), ("uno dos tres cuatro", "x y z w"), ("a", "b")], "d string, s string")
    out = [r[0] for r in df.select(text.choose_text(F.col("d"), F.col("s"))).collect()]
    assert out == ["a b c d", "uno dos tres cuatro x y z w", ""]


def test_shift_band_golden(spark):
    # 2024-01-01 is a Monday
    cases = {
        "2024-01-01 05:59:59": ("Stand-by", "2023-12-31"), "2024-01-01 06:00:00": ("Turno 1", "2024-01-01"),
        "2024-01-02 13:59:59": ("Turno 1", "2024-01-02"), "2024-01-02 14:00:00": ("Turno 2", "2024-01-02"),
        "2024-01-02 21:59:59": ("Turno 2", "2024-01-02"), "2024-01-02 22:00:00": ("Turno 3", "2024-01-02"),
        "2024-01-03 00:00:00": ("Turno 3", "2024-01-02"), "2024-01-06 03:00:00": ("Turno 3", "2024-01-05"),
        "2024-01-06 06:00:00": ("Turno 4", "2024-01-06"), "2024-01-06 14:00:00": ("Stand-by", "2024-01-06"),
        "2024-01-07 03:00:00": ("Stand-by", "2024-01-07"), "2024-01-08 03:00:00": ("Stand-by", "2024-01-07"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("ts", F.to_timestamp("s"))
    s, d = dates.shift_band(F.col("ts"))
    got = {r[0]: (r[1], str(r[2])) for r in df.select("s", s, d).collect()}
    assert got == cases


def test_resolution_date_rules(spark):
    df = spark.createDataFrame([(f"T{i}", dt.datetime(2024, 1, 31, 10, 0) + dt.timedelta(days=i)) for i in range(40)],
                               "number string, ts timestamp")
    for number, out in df.select("number", dates.resolution_date(F.col("ts"), F.col("number"))).collect():
        d = dt.datetime.strptime(out, "%d/%m/%Y %H:%M:%S")
        assert d.weekday() < 5 and d.hour == 10


def test_balance_fill_equals_greedy(spark):
    rnd = random.Random(7)
    for trial in range(5):
        members = {f"M{i}": rnd.choice([0, 0.5, 1, 2, 3.5, 7]) for i in range(rnd.randint(1, 6))}
        n = rnd.randint(0, 25)
        loads = dict(members)
        expect = []
        for _ in range(n):
            best = min(sorted(loads), key=lambda m: loads[m])
            expect.append(best)
            loads[best] += 1
        t = spark.createDataFrame([("g", f"N{k:03d}", k) for k in range(n)], "grp string, number string, ts int")
        m = spark.createDataFrame([("g", k, float(v)) for k, v in members.items()], "grp string, member_key string, effective double")
        got = [r[0] for r in assign.balance_fill(t, m, "grp", ["ts", "number"]).orderBy("ts").select("assigned_to").collect()]
        assert got == expect, (members, n)


def test_majority_repair_ties_first_seen(spark):
    rows = [(1, "t1", "a"), (2, "t1", "b"), (3, "t1", "b"), (4, "t1", "a"), (5, "t2", "x"), (6, "t2", "y"),
            (7, "t3", "sin_clasificar"), (8, "t3", "z")]
    df = spark.createDataFrame(rows, "ord int, txt string, clase string")
    r = labels.repair_ambiguous(df, "txt", "clase", "ord")
    got = {o: c for o, c in r.select("ord", "clase").collect()}
    assert got == {1: "a", 2: "a", 3: "a", 4: "a", 5: "x", 6: "x", 7: "sin_clasificar", 8: "z"}


def test_canonical_assignee_fallbacks(spark):
    users = spark.createDataFrame([(1, "jdoe", "John Doe", "1"), (2, "asmith", "Ann Smith", "0"), (3, "jdoe", "John X Doe", None)],
                                  "ord int, usuario string, nombre string, estado string")
    up = dimensions.prepare_users(users)
    names = spark.createDataFrame([(" jdoe ",), ("doe john x",), ("Smith Ann",), ("nobody",)], "n string")
    got = {r[0]: r[1] for r in dimensions.canonical_assignee(names, "n", up).collect()}
    assert got == {" jdoe ": "JDOE", "doe john x": "JDOE", "Smith Ann": "ASMITH", "nobody": "NOBODY"}
