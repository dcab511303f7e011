import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from mendline.llm import components, exact, simhash, substring

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_odd_rows(docs):
    got = exact.exact_duplicates(docs(), least=1).collect()
    groups = defaultdict(list)
    for r in docs().collect():
        groups[BLANK.sub(" ", r.text or "")].append(r.doc_id)
    kept = defaultdict(int)
    for r in got:
        text = BLANK.sub(" ", r.text or "")
        ids = [i for i in groups[text] if i is not None]
        assert r.keep_id == min(ids, default=None) and r.group_size == len(groups[text])
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
        kept[text] += r.kept
    assert len(got) == sum(map(len, groups.values())) and set(kept.values()) == {1}
    assert exact.exact_duplicates(docs([])).count() == 0


def test_exact_helper_names_may_be_columns(spark):
    names = ["common", "t_sha", "t_piece", "t_min", "pieces", "first", "norm", "sha", "piece", "count", "leader"]
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}", *range(len(names))) for i in range(40)], ["doc_id", "text", *names])
    got = exact.exact_duplicates(df, least=4).collect()
    assert sorted(r.doc_id for r in got if r.kept) == [0, 1, *range(2, 40, 2)] and {r.t_sha for r in got} == {1}


def test_exact_many_rows_without_identifier(docs):
    rows = [(None, "same text") for _ in range(300)] + [(i, "other") for i in range(5)]
    got = exact.exact_duplicates(docs(rows).repartition(4), least=20).collect()
    assert [(r.keep_id, r.group_size) for r in got if r.kept and r.text == "same text"] == [(None, 300)]
    mixed = exact.exact_duplicates(docs([(7, "same text"), *rows]).repartition(4), least=20).collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in mixed if r.kept and r.text == "same text"] == [(7, 7, 301)]
    assert all(r.keep_id == 7 for r in mixed if r.text == "same text")


def test_exact_common_text_in_pieces_and_clashing_names(docs):
    df = docs([(i, "common  text" if i % 3 else f"text {i}") for i in range(5, 305)]).withColumnRenamed("lang", "Norm").withColumnRenamed("source", "KEPT")
    got = exact.exact_duplicates(df, least=10)
    assert "Norm" in got.columns and "KEPT" not in got.columns
    rows = got.collect()
    common = [r for r in rows if r.group_size > 1]
    assert len(common) == 200 and {r.keep_id for r in common} == {5} and sum(r.kept for r in common) == 1
    assert all(r.kept and r.keep_id == r.doc_id for r in rows if r.group_size == 1)


def plain_fingerprint(text, words):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found)] if len(found) < words else [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(items, linked):
    parent = {k: k for k in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in items}


def test_simhash_against_brute_force(docs):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [pick.choice(words) for _ in range(120)]
        for _ in range(pick.randint(1, 6)):
            base = list(base)
            base[pick.randrange(120)] = pick.choice(words)
            texts.append(" ".join(base))
    rows = list(enumerate([*texts, "", None, "one", "ONE", "two words", *texts[:3]]))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(rows)).collect()}
    prints = {i: plain_fingerprint(t, 3) for i, t in rows}
    wanted = groups_of(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert all(r.fingerprint == f"{prints[i]:016x}" for i, r in got.items())
    assert len(set(wanted.values())) < len(rows) - 10


def test_simhash_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    pick = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        x = pick.getrandbits(64)
        for _ in range(pick.randint(1, 8)):
            x ^= 1 << pick.randrange(64)
            prints.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.near_links(df)).collect()}
    wanted = groups_of(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    sizes = defaultdict(int)
    for root in wanted.values():
        sizes[root] += 1
    assert found == {k: r for k, r in wanted.items() if sizes[r] > 1}


def test_simhash_odd_rows(docs):
    got = simhash.near_duplicates(docs()).collect()
    assert len(got) == docs().count() and simhash.near_duplicates(docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    pick = random.Random(6)
    names = pick.sample(range(-1000, 1000), 300)
    links = list(zip(names, names[1:]))
    del links[100]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links + links[:5], "u long, v long")).collect()}
    assert got == {n: min(names[:101]) for n in names[:101]} | {n: min(names[101:]) for n in names[101:]}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_substring(rows, width):
    first, words = {}, {}
    for i, t in rows:
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(words[i]) - width + 1):
            key = tuple(words[i][k:k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        drop = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                drop[k:k + width] = [True] * width
        out[i] = len(w), sum(drop), " ".join(a for a, d in zip(w, drop) if not d)
    return out


def test_substring_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 300)
    pick = random.Random(8)
    passages = [[f"p{j}_{i}" for i in range(40)] for j in range(4)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(pick.randint(0, 5)):
            if pick.random() < 0.5:
                p = pick.choice(passages)
                a = pick.randint(0, 20)
                words += p[a:a + pick.randint(5, 20)]
            else:
                words += [pick.choice("ab") for _ in range(pick.randint(1, 20))]
        rows.append((i, "  ".join(words)))
    rows += [(80, None), (81, "a " * 5000), (82, "a " * 4000)]
    df = docs(rows).repartition(5)
    got = substring.substring_duplicates(df, width=13).collect()
    wanted = plain_substring(rows, 13)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == wanted
    texts = {i: re.findall(r"\S+", t or "") for i, t in rows}
    factors = [(r.doc_id, f) for r in got for f in r.factors]
    assert factors
    for i, f in factors:
        assert f.ref < i and f.end - f.start >= 13
        assert texts[i][f.start:f.end] == texts[f.ref][f.ref_start:f.ref_start + f.end - f.start]


def test_substring_odd_rows(docs):
    got = substring.substring_duplicates(docs().withColumn("N_WORDS", F.lit("x"))).collect()
    assert len(got) == docs().count() and all(r.n_removed == 0 for r in got if r.doc_id != 8)
    assert substring.substring_duplicates(docs([])).count() == 0


def test_hash_of_a_group_is_the_same_everywhere():
    hasher = substring.Hasher()
    text = "x" * 70_000 + " one two three four five six seven one two three four five six"
    line, starts, ends = substring.line_of(text)
    groups = hasher.groups(hasher.prefix(line), starts, ends, 6)
    assert groups[1] == groups[8] and len(set(groups.tolist())) == len(groups) - 1


def index_load(df, width=13):
    """Windows that reach each index partition."""
    loads, inner = [], substring.look_up

    def look_up(segments):
        n = sum(len(segments.column("hashes")[i].as_py()) // substring.HASH_BYTES for i in range(segments.num_rows))
        out = inner(segments)
        return pa.table({name: pa.array([n] * (name == "n"), out.schema.field(name).type) if name == "n" else pa.array([0], out.schema.field(name).type)
                         for name in out.column_names})

    substring.look_up = look_up
    try:
        loads = [r.n for r in substring.repeated_runs(df, width=width, text="text", id_col="doc_id").collect()]
    finally:
        substring.look_up = inner
    return loads


def test_substring_hot_anchor_is_dealt_out(docs, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 300)
    hasher = substring.Hasher()
    least = lambda t: substring.windows(hasher, t, 6)[1].min()
    hot = min((f"phrase {k} that all do hold" for k in range(1000)), key=least)  # the anchor of every window around it
    rows = [(i, " ".join([*(f"a{i}_{j}" for j in range(12)), hot, *(f"b{i % 150}_{j}" for j in range(12))])) for i in range(300)]
    df = docs(rows).repartition(3)
    got = substring.substring_duplicates(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == plain_substring(rows, 13)
    with_hot = max(index_load(df))
    monkeypatch.setattr(substring, "hot_ranges", lambda df, parts, **_: np.zeros(parts, bool))
    assert with_hot < max(index_load(df)) / 2


def test_substring_repeats_inside_a_document_are_sent_once(docs, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 300)
    period = " ".join(f"w{j}" for j in range(20))
    rows = [(1, f"{period} x"), (2, f"y {period} " + f"{period} " * 30), (3, "z " * 2000), (None, f"{period} " * 3), (4, "z " * 40 + period)]
    df = docs(rows).repartition(4)
    got = substring.substring_duplicates(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got if r.doc_id} == plain_substring([r for r in rows if r[0]], 13)
    assert [r.n_removed for r in got if r.doc_id is None] == [60]
    assert sum(index_load(df)) < 250


def test_substring_rows_without_id_are_told_apart(docs):
    tail = " ".join(f"w{i}" for i in range(12)) + " and the rest"
    # "plumless" and "buckeroo" have the same crc32.
    rows = [(1, f"plumless {tail} of one"), (None, f"plumless {tail}"), (None, f"buckeroo {tail}"), *[(None, f"plumless {tail}")] * 3]
    got = substring.substring_duplicates(docs(rows).repartition(3)).collect()
    assert sorted(r.n_removed for r in got if r.doc_id is None and r.text.startswith("buckeroo")) == [15]
    assert {(r.n_removed, len(r.factors)) for r in got if r.doc_id is None and r.text.startswith("plumless")} == {(16, 1)}
