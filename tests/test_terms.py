"""Search terms, paragraphs and documents on small fixtures."""

from factloom.operators import matching, paragraphs


def test_search_terms(spark):
    names = ["Relief Act of 1997 and Balanced Budget Act of 1997", "Changes in Depreciation Guidelines and Revenue", "Package (Tariff of Trade) of 1990", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {}
    for r in matching.search_terms(df).collect():
        got.setdefault(r["name"], {})[r["term"]] = r["mechanism"]
    assert got == {
        names[0]: {names[0]: "Full name", "Relief Act of 1997": "Split on 'and'", "Balanced Budget Act of 1997": "Split on 'and'"},
        names[1]: {names[1]: "Full name", "Changes in Depreciation Guidelines": "Split on 'and'", "changes of the depreciation guidelines": "Action + subject", "changes of depreciation guidelines": "Action + subject"},
        names[2]: {names[2]: "Full name", "Tariff of Trade": "Parenthetical", "Tariff of the Trade": "Parenthetical + article", "Package of 1990": "Before parenthetical"},
    }


def test_contains_either_and_nulls(spark):
    df = spark.createDataFrame([("Tax Act", "tax"), ("x", "X y"), ("a", "b"), (None, "b")], "a string, b string")
    assert [r[0] for r in df.select(matching.contains_either(df.a, df.b)).collect()] == [True, True, False, None]


def test_paragraphs_split_on_blank_lines_and_mark_repeats(spark):
    df = spark.createDataFrame([(1, "The 1 tax\n\nA b\n \nthe 1 TAX"), (2, None), (3, "")], "doc_id long, text string")
    rows = paragraphs.paragraph_features(df, "doc_id", "text", ("tax",)).collect()
    assert sorted((r.paragraph_number, r.paragraph, r.n_tokens, r.n_numbers, r.relevant, r.is_duplicate) for r in rows) == [(1, "the 1 tax", 3, 1, 1, 1), (2, "a b", 2, 0, 0, 0), (3, "the 1 tax", 3, 1, 1, 1)]


def test_document_texts_follow_page_order(spark):
    df = spark.createDataFrame([(1, 2, "b c"), (1, 1, "a"), (2, 1, None)], "d long, n int, t string")
    assert sorted(tuple(r) for r in paragraphs.document_texts(df, "d", "n", "t").collect()) == [(1, "a b c", 3), (2, "", 0)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "name string")
    assert matching.search_terms(empty).count() == 0
    assert matching.coverage_status(empty, empty, empty).count() == 0


def test_automaton_and_join_find_the_same(spark):
    texts = spark.createDataFrame([(1, "abcabc bc"), (2, None), (3, ""), (4, "été abc"), (5, "zzz")], "k int, t string")
    terms = spark.createDataFrame([("abc",), ("bc",), ("bc",), ("ét",), ("",), (None,), ("q",)], "term string")
    want = [(1, "abc"), (1, "bc"), (4, "abc"), (4, "bc"), (4, "ét")]
    for most in (10, 2):
        assert sorted((r.k, r.term) for r in matching.holding(texts, "t", terms, "term", most).collect()) == want
    assert matching.holding(texts, "t", terms.limit(0), "term").count() == 0


def test_shorter_probes_count_only_without_longer_ones(spark):
    long_, short = "a b c " * 30, "a b c " * 11 + "else"
    chunks = spark.createDataFrame([(1, 1, short), (1, 2, long_), (2, 1, "q r s " * 11 + "x")], "doc_id long, chunk_id int, text string")
    passages = spark.createDataFrame([("long", long_), ("cut", "q r s " * 30), ("tiny", "a b"), ("none", "z y " * 40), (None, None)], "name string, passage string")
    got = matching.passage_matches(chunks, passages, ["doc_id", "chunk_id"], ["doc_id", "chunk_id"])
    assert sorted((r.name, r.doc_id, r.chunk_id) for r in got.collect()) == [("cut", 2, 1), ("long", 1, 2)]
