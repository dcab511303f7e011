import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from mendline.llm.queries import ORACLES, QUERIES
from test_duplicates import groups_of, plain_fingerprint
from test_pii import plain


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    folder = "/root/testdata/sf0.001"
    docs = cp.table(spark, folder, "documents")
    out = [docs]
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, folder), "test-stage")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_stage_keeps_texts_with_letters(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert all(after[i].text == before[i].text for i in after)


def test_exact_stage_keeps_the_smallest_of_equal_texts(stages):
    before, after = rows(stages[1]), rows(stages[2])
    groups = defaultdict(list)
    for i, r in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text)].append(i)
    assert set(after) == {min(g) for g in groups.values()}


def test_near_stage_keeps_one_of_each_group(stages):
    before, after = rows(stages[2]), rows(stages[3])
    prints = {i: plain_fingerprint(r.text, 3) for i, r in before.items()}
    groups = groups_of(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert set(after) == set(groups.values())


def test_near_stage_knows_rows_by_id_and_text(spark, docs):
    a, b = "one two three four five six seven", "nothing that looks like it at all here"
    make = lambda rows: cp.stored(docs(rows), "near-input")
    kept = cp.near_stage(spark, make([(1, a), (5, a + "."), (5, b), (None, a), (None, a), (None, a + "!")]), "")
    near = {plain_fingerprint(t, 3) for t in (a, a + ".", a + "!")}
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert (1, a) in got and (5, b) in got and (None, a) not in got
    assert len(got) == 2 + sum(min((plain_fingerprint(a, 3) ^ p).bit_count(), 4) > 3 for p in near)
    again = cp.near_stage(spark, make([(1, a), (1, a), (None, b), (None, b)]), "").collect()
    assert sorted(((r.doc_id, r.text) for r in again), key=str) == [(1, a), (None, b)]
    assert cp.near_stage(spark, make([]), "").collect() == []


def test_personal_data_is_gone(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    assert all(not plain(r.text) and r.n_chars == len(r.text) for r in after.values())
    assert all(r.text == before[i].text for i, r in after.items() if not plain(before[i].text))


def test_stages_keep_the_columns_of_documents(stages):
    assert all(tuple(s.columns) == cp.COLUMNS and s.dtypes == stages[0].dtypes for s in stages[:5])


def test_packing_covers_every_document(stages):
    tokens, got = {}, defaultdict(int)
    for r in stages[5].collect():
        tokens[r.doc_id] = r.doc_tokens
        got[r.doc_id] += r.length
    assert got == tokens and set(got) == set(rows(stages[4]))


def test_stages_on_odd_and_empty_tables(spark, docs, sf):
    for make in (docs(), docs([])):
        df = make
        for _, stage in cp.STAGES:
            df = cp.stored(stage(spark, df, sf), "test-stage")
        assert (df.count() > 0) == (make.count() > 0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, sf, name):
    from oracle_check import compare, duck

    assert compare(duck(sf), QUERIES[name](spark, sf), ORACLES[name]) is None
