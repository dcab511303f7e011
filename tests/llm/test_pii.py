import time
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendline.llm import pii

# The contract's rules, as they stand.
RULES = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+".replace("[\\x20-]", "[\\x20\\-]")), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = (lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
             lambda m: 12 <= len(digits(m)) <= 19 and pii.passes_luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15)
    return sorted((m.start(), k, m.end()) for k, (r, t) in enumerate(zip(RULES, tests)) for m in r.finditer(text) if t(m[0]))


def test_base_spans_against_the_rules():
    pick = random.Random(1)
    parts = ["a", "b.c", "@", "x@y.z", "1", "12", "255", "256", ".", "-", " ", "  ", "+", "(", ")", "4111 1111 1111 1111", "4524132264652876",
             "+1 (444) 555-3382", "é", "10.0.0.1", "\n", "%", "_", "007", "Z"]
    for _ in range(20_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_luhn():
    assert pii.passes_luhn("4111111111111111") and not pii.passes_luhn("4111111111111112")


def test_long_texts_take_no_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1(" * 100_000, "1." * 100_000, "1 2 " * 50_000,
                 "[at]" * 100_000, "a[at]b." * 50_000, "[at]" * 50_000 + " x[at]" * 20_000):
        start = time.perf_counter()
        pii.spans_of(text, {"call": 3})
        list(pii.like_strings(text))
        assert time.perf_counter() - start < 20


def contextual(n=60):
    rows = []
    for i in range(n):
        rows.append((i, f"some words here and there call +1 555 {i:03d} 8{i:03d} or write to mail: user{i}@host.example.org soon"))
    rows += [(1000, "please call 555-0199 and mail: jane (at) host"), (1001, "the number 555-0199 and more"),
             (1002, "order 20240101 came, nobody to thank"), (1003, "mail: jane.doe(at)host.example.org.")]
    return rows


def test_patterns_find_unseen_identifiers(docs):
    df = docs(contextual())
    patterns = pii.bootstrap(df)
    assert patterns.get("call") == pii.KINDS.index("phone") and patterns.get("mail:") == pii.KINDS.index("email")
    assert not {"the", "or", "and"} & set(patterns)
    got = {r.doc_id: (r.text, r.spans) for r in pii.find(df, patterns).collect()}
    text, spans = got[1000]
    assert [(s.kind, text[s.start:s.end], s.added) for s in spans] == [("phone", "555-0199", True)]
    assert got[1001][1] == [] and got[1002][1] == []
    text, spans = got[1003]
    assert [(s.kind, text[s.start:s.end]) for s in spans] == [("email", "jane.doe(at)host.example.org")]


def test_common_words_are_no_patterns(docs):
    rows = [(i, f"the a the word +1 555 {i:03d} 8{i:03d} the of the") for i in range(40)] + [(100 + i, "of the word word and the word word of the 123456") for i in range(40)]
    assert pii.bootstrap(docs(rows)) == {}


def test_masking_and_odd_rows(docs):
    got = pii.find(docs([(1, "é a@b.cd, 10.0.0.1 +49 170 1234567."), (2, None), (3, "")]), {}, mask=True).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["é <email>, <ip> <phone>.", None, ""]
    rows = pii.extract(docs().withColumn("SPANS", F.lit(1))).collect()
    assert len(rows) == docs().count() and all(isinstance(r.spans, list) for r in rows)
    assert pii.extract(docs([])).count() == 0


def plain_occurrences(texts):
    """By trying every place: white space behind a context makes no further occurrence of it."""
    return Counter(c for t in texts for p in range(1, len(t) + 1) if not t[p - 1].isspace() for c in pii.contexts(t, p))


def test_occurrences_are_cut_as_contexts(monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 64)
    monkeypatch.setattr(pii, "REACH", 12)
    pick = random.Random(4)
    parts = ["a", "Call", "(", "+1", '"', "<", "=", ":", " ", "  ", "\n", "id#", "\u0130", "\u03a3", "\u3000", "\U0001d4d0", "x@y.com", "longer_than_that"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 120))) for _ in range(60)]
    wanted = plain_occurrences(texts)
    assert pii.Places().count(texts, np.full(pii.FILTER_BITS // 8, 255, np.uint8)) == wanted
    places = pii.Places()
    some = sorted(wanted)[::7]
    got = places.count(texts, pii.filter_of([places.of_context(c) for c in some]))
    assert {c: got[c] for c in some} == {c: wanted[c] for c in some}


@pytest.mark.parametrize("before, behind, kind", [('email="', '"', "email"), ("Name <", ">", "email"), ("call (", ")", "phone"), ("id#", "", "phone")])
def test_glued_contexts_find_unseen_identifiers(docs, before, behind, kind):
    seed, unseen = ("user{0}@host.example.org", "jane(at)host") if kind == "email" else ("+1 555 {0:03d} 8{0:03d}", "+555-0199")
    rows = [(i, f"word {before}{seed.format(i)}{behind} more") for i in range(40)] + [(1000, f"word {before}{unseen}{behind} more")]
    lone = [(2000 + i, 'a " b ( c < d id# e calling Named emails') for i in range(9)]
    df = docs(rows + lone)
    got = {r.doc_id: (r.text, r.spans) for r in pii.extract(df).collect()}
    text, spans = got[1000]
    assert [(s.kind, text[s.start:s.end], s.added) for s in spans] == [(kind, unseen, True)]
    assert all(not got[2000 + i][1] for i in range(9))


def test_a_lone_sign_does_not_make_the_glued_one_sure(docs):
    rows = [(i, f'say "user{i}@host.example.org" now') for i in range(20)] + [(100 + i, 'say "word" and "more" now') for i in range(40)]
    rows += [(200, 'a " b'), (201, 'say "jane(at)host" now')]
    assert '"' + pii.GLUED not in pii.bootstrap(docs(rows)) and 'say "' + pii.GLUED not in pii.bootstrap(docs(rows))


def test_a_rare_context_counts_whatever_else_the_corpus_holds(docs):
    common = [(i, " ".join(f"from hot +1 555 {i:03d} 8{j:03d} and" for j in range(100))) for i in range(100)]
    rare = [(1000 + i, f"here dial +1 555 {i:03d} 8{i:03d} soon") for i in range(6)]
    unseen = [(2000, "here dial 555-0199"), (2000, "here dial 555-0199"), (None, "other, dial 555-0199"), (2001, None), (2001, "number 555-0199")]
    got = pii.extract(docs(common + rare + unseen).withColumn("Text_Key", F.lit(1))).where("doc_id >= 2000 OR doc_id IS NULL").collect()
    assert sorted((str(r.doc_id), r.text, [(s.kind, s.start, s.added) for s in r.spans]) for r in got if r.text) == [
        ("2000", "here dial 555-0199", [("phone", 10, True)]), ("2000", "here dial 555-0199", [("phone", 10, True)]),
        ("2001", "number 555-0199", []), ("None", "other, dial 555-0199", [("phone", 12, True)])]
    assert len(got) == 5


def test_what_the_filter_lets_through_changes_nothing(docs, monkeypatch):
    rows = contextual() + [(3000, "words call 555-0198 here")]
    spans = lambda: sorted((r.doc_id, str(r.spans)) for r in pii.extract(docs(rows)).collect())
    wanted = spans()
    monkeypatch.setattr(pii, "passes", lambda known, hashes: np.ones(len(hashes), bool))
    assert spans() == wanted
