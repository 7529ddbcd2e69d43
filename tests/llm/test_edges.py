"""Cases at the edges of the operators: signs that only look like letters, lines of all documents beyond the broadcast bound."""

import pytest

from palimpsest.llm import langid, lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_words_are_letters():
    assert langid.words_of("Ab ½cd² Ⅷ ①x_y 3z été Ελλ 漢字") == ["ab", "cd", "x", "y", "z", "été", "ελλ", "漢字"]
    assert langid.words_of("½ ² ① Ⅷ ௰ 〡") == [] and langid.words_of("") == []


def test_signs_like_letters_have_no_language(spark):
    rows = [(i, f"{'the of and with words' if i % 2 else 'der und mit das nicht'} {i}", "en" if i % 2 else "de", "s", 0) for i in range(60)]
    odd = ["½ ² ①", "Ⅷ Ⅸ", "12 34", "", None, "③ the words of"]
    df = spark.createDataFrame(rows + [(1000 + k, t, "xx" if k < 5 else "en", "s", 0) for k, t in enumerate(odd)], SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(df).filter("doc_id >= 1000").collect()}
    assert [got[1000 + k] for k in range(6)] == ["und"] * 5 + ["en"]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_a_line_of_all_documents(spark, monkeypatch, bound):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", bound)
    rows = [(i, f"own line {i}\nsubscribe to our letter\n{'shared by three' if i % 10 == 0 else 'another'} {i % 3}", "en", f"s{i % 7}", 0) for i in range(200)] + [(None, "subscribe to our letter", "en", "s1", 0)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.line_report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    seen: dict[str, list] = {}
    for i, text, _, site, _ in rows:
        for line in text.split("\n"):
            seen.setdefault(line, []).append((site, i))
    expected = {}
    for i, text, *_ in rows:
        spread = [seen[line] for line in text.split("\n")]
        removed = sum(len({s for s, _ in at}) >= 5 and i != min(d for _, d in at if d is not None) for at in spread)
        expected[i] = (len(spread), removed)
    assert got == expected and max(r for _, r in expected.values()) == 2
