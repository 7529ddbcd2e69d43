"""Reasons of divergence, canonical form and timeline dedupe on literal cases and against plain models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import divergence as D

LONG = "The holder of a permit shall notify the authority of every change. The authority may then amend the permit. A fee is charged for that."


@pytest.mark.parametrize(("replay", "oracle", "blamed", "code", "reason"), [
    (LONG, LONG, None, "identical", "same_text"), (None, "", None, "identical", "same_text"), (LONG, LONG.upper().replace(" ", "\n"), None, "editorial_convention", "same_letters"), (LONG, "3 § 3 § ", None, "editorial_convention", "bare_stub"),
    (LONG, "47 § 47 § on kumottu L:lla 30.12.1994/1218.", None, "oracle_stale", "repeal_notice"), (LONG, "11 § on kumottu L:lla 1/2020, joka tulee voimaan 1.1.2030. Aiempi sanamuoto kuuluu: " + LONG, None, "oracle_stale", "future_repeal_overlay"),
    (LONG, "11 § on kumottu asetuksella. Aiempi sanamuoto kuuluu: " + LONG, None, "oracle_stale", "repeal_with_prior_wording"), (LONG, LONG + " A fee is charged for that.", "REPLACE", "oracle_stale", "duplicate_sentence"),
    (LONG, LONG.replace("The authority", "An old sentence of sixty letters stays here although it went. The authority"), "REPLACE", "oracle_stale", "residual_sentences"), (LONG, "One old sentence. " + LONG + " Another old sentence that is left.", None, "oracle_stale", "residual_sentences"),
    (LONG, LONG.replace("notify", "notifiy"), "REPLACE", "source_pathology", "tiny_edit"), (LONG, LONG.replace("of every", "<b"), "REPLACE", "source_pathology", "bounded_phrase"), (LONG, LONG.replace("of every", "b"), "REPLACE", "unknown", "similar_length"),
    (LONG, LONG.replace("of every", "b"), None, "source_pathology", "bounded_phrase"), (LONG, LONG[:60], "INSERT", "oracle_stale", "amendment_not_in_oracle"), (LONG, LONG[:60], "REPEAL", "replay_extra", "much_more_text"), (LONG[:60], LONG, "REPEAL", "replay_missing", "much_less_text"),
])
def test_reasons(spark, replay, oracle, blamed, code, reason):
    df = spark.createDataFrame([(replay, oracle, blamed)], "r string, o string, b string")
    assert tuple(df.select(D.divergence_reason(F.col("r"), F.col("o"), F.col("b")).alias("d")).first()["d"]) == (code, reason)


def test_each_step_of_a_reason_is_evaluated_once(spark):
    df = spark.createDataFrame([(LONG, LONG[:60], None)], "r string, o string, b string").select(D.divergence_reason(F.col("r"), F.col("o"), F.col("b")).alias("d"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("levenshtein") == 2 and plan.count("[^a-z0-9äöå]") == 4 and plan.count(D.PRIOR_WORDING) == 1


def test_repealed_by(spark):
    texts = ["47 § on kumottu L:lla 30.12.1994/1218.", "3 a § 3 a § on kumottu A 1999/07", "47 § on kumottu", "1 momentti on kumottu L:lla 1994/1218.", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(D.repealed_by(F.col("t"))).collect()] == ["1994/1218", "1999/7", None, None, None]


def test_extra_sentences_against_all_subsets(spark):
    r, cases = random.Random(3), []
    for _ in range(300):
        replay = [r.choice("abc") for _ in range(r.randint(0, 5))]
        oracle = list(replay) if r.random() < 0.7 else [r.choice("abc") for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 3)):
            oracle.insert(r.randint(0, len(oracle)), r.choice("abcx"))
        cases.append((oracle, replay))

    def fewest(oracle, replay):
        k = len(oracle) - len(replay)
        at = 0
        for x in oracle:
            at += at < len(replay) and x == replay[at]
        return k if 1 <= k <= 2 and at == len(replay) and replay else None

    df = spark.createDataFrame(cases, "o array<string>, r array<string>")
    got = [x[0] for x in df.select(D.extra_sentences(F.col("o"), F.col("r"))).collect()]
    assert got == [fewest(*c) for c in cases] and {None, 1, 2} == set(got)


NODES = "doc_id int, addr string, kind string, label string, text string, status string"


def test_canonical_form(spark):
    left = spark.createDataFrame([
        (1, "s:3", "section", "3", "3 §.  The “holder” – of a per­mit , pays.", "live"), (1, "s:3/i:2", "item", "2", "2) fee", "live"), (1, "s:4", "section", "4", "gone", "tombstone"), (1, "s:5", "section", "5", " - ", "live"), (1, "s:6", "section", "6", "only left", "live"), (1, "s:7", "section", "7", "see 5§ and", "live"), (1, "s:8", "section", "3 a", "3 A § text", "live")], NODES)
    right = spark.createDataFrame([(1, "s:3", "section", "3", 'The "holder" - of a permit, pays.', "live"), (1, "s:3/i:2", "item", "2", "fees", "live"), (1, "s:7", "part", "7", "see 5 § and", "live"), (1, "s:8", "section", "3 a", "text", "live"), (1, "s:9", "section", "9", "only right", "live")], NODES)
    a, b = D.canonical_nodes(left), D.canonical_nodes(right)
    got = {r["addr"]: (r["canonical"], r["fired"], r["occupancy"]) for r in a.collect()}
    assert got["s:3"] == ('The "holder" - of a permit, pays.', ["label_prefix", "soft_hyphen", "dashes", "double_quotes", "space_before_mark"], "substantive")
    assert got["s:3/i:2"][0] == "fee" and got["s:4"][2] == "tombstone" and got["s:5"][2] == "empty" and got["s:8"][0] == "text" and got["s:7"][:2] == ("see 5 § and", ["section_sign"])
    again = D.canonical_nodes(a.drop("fired", "occupancy").withColumn("text", F.col("canonical")).drop("canonical"))
    assert {r["addr"]: r["canonical"] for r in again.collect()} == {k: v[0] for k, v in got.items()}
    assert {(r["addr"], r["residual"]) for r in D.canonical_residuals(a, b).collect()} == {("s:3/i:2", "text"), ("s:6", "missing_right"), ("s:9", "missing_left"), ("s:7", "kind")}


def test_canonical_form_against_patterns(spark):
    """Labels and typography at random against one pattern a rule, with a prefix compiled for each label."""
    white = "[ \t\n\x0b\f\r]*"
    rules = [("soft_hyphen", "\u00ad", ""), ("spaces", "[ \t\n\x0b\f\r\u00a0\u2007\u202f]+", " "), ("dashes", "[‐‑‒–—―]", "-"), ("double_quotes", "[“”„«»]", '"'), ("single_quotes", "[‘’‚`´]", "'"), ("space_before_mark", r" +([,.;:!?)])", r"\1"), ("section_sign", rf"([0-9][a-zåäö]?){white}§", r"\1 §")]
    r, rows, expected = random.Random(5), [], {}
    labels = ["3", "3 a", "A.1", " 3", "Ä", "a\x00b", "x\\d", "", None, "K"]
    for k in range(1500):
        label, kind = r.choice(labels), r.choice(["section", "item", None])
        said = r.choice([label or "", (label or "").swapcase(), "3", "\u212a"])
        text = r.choice(["", " ", "\t  "]) + said + r.choice(["", " ", "\n"]) + r.choice(["§", "§.", ")", ""]) + "".join(r.choice("ab9 5§  ,.:)\t\n\x0b\u00ad\u00a0\u2007\u202f‐―“»‘`´-") for _ in range(r.randint(0, 14)))
        rows.append((k, f"n{k}", kind, label, text, "live"))
        mark = rf"{white}§[.:]?{white}" if kind == "section" else rf"{white}\){white}"
        steps = [text, re.sub(rf"(?ai)\A{white}{re.escape(label)}{mark}", "", text, count=1) if label else text]
        names = ["label_prefix"]
        for name, pattern, to in rules:
            steps.append(re.sub(pattern, to, steps[-1]))
            names.append(name)
        letters = any(c.isalnum() for c in steps[-1])
        expected[k] = (steps[-1].strip(" "), [n for n, a, b in zip(names, steps, steps[1:]) if a != b], "substantive" if letters else "empty")
    got = {x["doc_id"]: (x["canonical"], x["fired"], x["occupancy"]) for x in D.canonical_nodes(spark.createDataFrame(rows, NODES)).collect()}
    assert got == expected and {n for _, fired, _ in expected.values() for n in fired} == {"label_prefix", *(n for n, _, _ in rules)}


def test_canonical_form_is_evaluated_once_and_compared_where_it_is_grouped(spark):
    from palimpsest.plans.divergence_queries import canonical_residuals

    plan = canonical_residuals(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count(r"(\d[a-zåäö]?)\s*§") == 2
    assert plan.sparkPlan().toString().count("SortMergeJoin") == 1 and plan.executedPlan().toString().count("Exchange hashpartitioning") == 2


VERSION = "addr string, source string, effective string, enacted string, expires string, variant string, applicability string, shape string, content string, pos int"


def modelled(rows):
    """The three rules, one after the other, over lists."""
    kept, records = [], {}
    for addr in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == addr), key=lambda r: r[9])
        for rule in ("absent", "relabel"):
            groups = {}
            for r in own:
                if r[1]:
                    groups.setdefault((r[1], r[2], r[3], r[5]), []).append(r)
            gone = set()
            for key, g in groups.items():
                with_, without = [r for r in g if r[8] is not None], [r for r in g if r[8] is None]
                snaps = [r for r in with_ if r[7] == "relabel"]
                others = [r for r in with_ if r[7] not in ("relabel", "renumber")]
                solid = [r for r in others if r[7] != "shell"]
                if rule == "absent":
                    name, drop = "absent_content_shadow", without if with_ else []
                else:
                    name, drop = ("relabel_snapshot_shadow", snaps) if solid else ("relabel_shell_shadow", others if snaps else [])
                if drop:
                    records[addr, *key, name] = len(drop)
                    gone |= {r[9] for r in drop}
            own = [r for r in own if r[9] not in gone]
        out, at = [], {}
        for r in own:
            key = (r[1], r[2], r[3], r[4], r[5], r[6], re.sub(r"(\d[A-Za-zåäö]?)\s*§", r"\1 §", " ".join(r[8].split()))) if r[1] and r[8] is not None else None
            if key is None or key not in at:
                if key is not None:
                    at[key] = len(out)
                out.append((r, r[9]))
            else:
                name = (addr, r[1], r[2], r[3], r[5], "same_source_semantic")
                records[name] = records.get(name, 0) + 1
                out[at[key]] = (r, out[at[key]][1])
        kept += [(r[0], r[9], place) for r, place in out]
    return set(kept), records


def test_timeline_dedupe(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), r.choice(["", None, "x", "x", "y"]), r.choice(["2020", "2021"]), "2019", r.choice([None, "2030"]), r.choice(["permanent", "temporary"]), r.choice([None, "fi"]), r.choice([None, None, "relabel", "shell", "renumber"]), r.choice([None, "3 § text", "3§  text", "other"]), k) for k in range(160)]
    kept, records = D.dedupe_timeline(spark.createDataFrame(rows, VERSION))
    expected = modelled(rows)
    assert {(x["addr"], x["pos"], x["place"]) for x in kept.collect()} == expected[0]
    assert {(x["addr"], x["source"], x["effective"], x["enacted"], x["variant"], x["rule"]): x["removed"] for x in records.collect()} == expected[1]
    assert {k[-1] for k in expected[1]} == {"absent_content_shadow", "relabel_snapshot_shadow", "relabel_shell_shadow", "same_source_semantic"}
