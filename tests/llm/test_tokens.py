import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mendline.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = [chr(i) for i in range(1, 0x250)] + [chr(i) for i in (
    0x3A3, 0x3C2, 0x130, 0x301, 0x308, 0x2000, 0x3000, 0x200B, 0xFEFF, 0x1D15E, 0xAC00, 0x1100, 0x1161, 0x11A8, 0x1F600,
    0x212B, 0x660, 0xBC, 0x85, 0xA0, 0x1C, 0x1680, 0xFB01, 0x558, 0x1C89)] + ["<|endoftext|>", "<|", "'s", "'S", "'re", "ABC", " ", "\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n):
    pick = random.Random(5)
    return ["".join(pick.choice(SIGNS) for _ in range(pick.randint(0, 30))) for _ in range(n)]


def test_ids_and_texts_agree_with_the_library(library):
    coder, ids_of = bpe.WordCoder(PATH), packing.LibraryIds(PATH)
    for text in odd_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == ids == ids_of(text).tolist()
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memory_keeps_what_is_in_use():
    made = []
    memory = bpe.Memory(lambda k: made.append(k) or k, 3 * (bpe.ENTRY + 2))
    for k in "123141561":
        assert memory[k] == k
    assert made.count("1") == 1 and len(memory) <= 3


def test_memory_is_bounded_in_bytes():
    memory = bpe.Memory(lambda k: k * 3, 10_000)
    for i in range(2000):
        key = f"{i}-" * (i % 90)
        assert memory[key] == key * 3
    assert all(sum(len(k) + len(v) + bpe.ENTRY for k, v in m.items()) <= 10_000 + bpe.LONG * 4 + bpe.ENTRY for m in (memory, memory.older))
    assert not any(len(k) > bpe.LONG for k in memory)


def test_plain_and_odd_texts_have_the_ids_of_the_library(monkeypatch):
    monkeypatch.setattr(packing, "STEP", 20)
    ids_of, pick = packing.library_ids(PATH), random.Random(2)
    signs = [chr(i) for i in range(0x530)] + list("文\U0001d4d0\u3000 ")
    texts = ["Word, word. WORD!\nit's 12.5 (so). Ünï", "a" * 50, "", " \n", "\u03a5\u0300", "Ⱥ b", "<|endoftext|> x."]
    texts += ["".join(pick.choice(signs if pick.random() < 0.2 else signs[:128] + list(".,!? \n") * 6) for _ in range(pick.randint(0, 60)))
              for _ in range(4000)]
    for t in texts:
        assert ids_of(t).tolist() == ids_of.library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_places_cover_the_stream():
    pick = random.Random(3)
    for _ in range(200):
        ends = np.cumsum([pick.randint(1, 100) for _ in range(pick.randint(1, 8))])
        sentences = np.array(sorted(pick.sample(range(1, int(ends[-1]) + 1), min(int(ends[-1]), pick.randint(0, 9)))), np.int64)
        at, price = packing.places(ends, sentences)
        known = sorted({*ends.tolist(), *sentences.tolist()})
        want = {k: 0 if k in ends else packing.SENTENCE for k in known}
        for a, b in zip([0, *known], known):
            want |= {p: packing.ELSEWHERE for p in range(a + packing.APART, b, packing.APART)}
        assert dict(zip(at.tolist(), price.tolist())) == want and list(at) == sorted(at)


def test_width_is_checked(docs):
    for width in (16, 100):
        with pytest.raises(ValueError):
            packing.pack(docs(), PATH, width=width)


def test_columns_of_odd_rows(docs, library):
    coded = bpe.encode(docs(), PATH, decoded="plain")
    for r in coded.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.plain == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode(coded, PATH, decoded="Plain").collect()
    assert all(r.Plain == library.decode(r.ids, skip_special_tokens=False) for r in again)
    assert bpe.encode(docs([]), PATH).count() == 0


def check_pieces(rows, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        place = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == place and p.length > 0
            place += p.length
        assert place <= 4096
        by_doc[len(by_doc)] = place
    return by_doc.values()


def test_packing_holds_every_id_once(docs, library):
    df = docs().coalesce(1)
    rows = packing.pack(df, PATH, with_ids=True).collect()
    check_pieces(rows, None)
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 2])
    got = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        got[r.doc_id].append((r.start, r.ids))
    for doc, wanted in texts.items():
        assert sorted(t for w in wanted for t in w) == sorted(t for _, ids in got[doc] for t in ids)
        if len(wanted) == 1:
            assert [t for _, ids in sorted(got[doc]) for t in ids] == wanted[0]
    assert packing.pack(docs([]), PATH).count() == 0


def test_blocks_give_whole_streams_with_little_padding(docs, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20_000)
    ends = np.zeros(60_000, bool)
    ends[269] = True
    stream = packing.Stream(4096, ends, 0, True)
    pick, made, rows = np.random.default_rng(1), [], []
    for doc in range(300):
        ids = pick.integers(0, 50_000, pick.integers(1, 1500)).astype(np.uint32)
        ids[pick.random(len(ids)) < 0.05] = 269
        made.append(ids)
        stream.add(doc, ids)
        if stream.held >= packing.BLOCK:
            rows += stream.pack(False).to_pylist()
    rows += stream.pack(True).to_pylist()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    for doc, ids in enumerate(made):
        parts = sorted(got[doc], key=lambda r: r["start"])
        assert [t for r in parts for t in r["ids"]] == ids.tolist() and all(r["doc_tokens"] == len(ids) for r in parts)
    used = defaultdict(int)
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used.values())
    assert max(used.values()) <= 4096 and padding < 0.01 * sum(map(len, made))


def test_cuts_are_the_cheapest():
    pick = random.Random(2)
    for _ in range(300):
        at = np.cumsum([pick.randint(1, 6) for _ in range(pick.randint(1, 14))])
        price = np.array([pick.randint(0, 9) for _ in at])
        best = {0: 0}
        for t, p in zip(at.tolist()[:-1], price.tolist()):
            best[t] = min(v + p + 16 - (t - s) for s, v in best.items() if t - s <= 16)
        least = min(v for s, v in best.items() if at[-1] - s <= 16)
        cost, start, found = 0, 0, packing.cuts(at, price, 16)
        for end in found[:-1]:
            assert end - start <= 16
            cost += int(price[at.tolist().index(end)]) + 16 - (end - start)
            start = end
        assert found[-1] == at[-1] and found[-1] - start <= 16 and cost == least
