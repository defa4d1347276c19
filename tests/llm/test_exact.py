import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from stockyard.llm import exact
from stockyard.llm.trie import PatriciaTrie

from .helpers import awkward, documents, lower

KEYS = st.lists(st.tuples(st.text("ab", max_size=8), st.one_of(st.none(), st.integers(0, 9))), max_size=40)


def expected(pairs, largest):
    out = {}
    for text, owner in pairs:
        size, best, copies = out.get(text, (0, None, 0))
        if owner == best:
            copies += 1
        elif best is None or (owner is not None and (owner > best) == largest):
            best, copies = owner, 1
        out[text] = (size + 1, best, copies)
    return out


def told(nodes):
    return {n.text[: n.end].decode(): (n.size, n.owner, n.owner_copies) for n in nodes}


@settings(max_examples=200, deadline=None)
@given(KEYS, st.booleans())
def test_trie_is_a_dictionary(pairs, largest):
    trie = PatriciaTrie(largest)
    for text, owner in pairs:
        trie.insert(text.encode(), owner)
    assert trie.held == sum(len(t) for t in {t for t, _ in pairs})
    nodes = list(trie.spill_all())
    assert [n.text[: n.end] for n in nodes] == sorted(t.encode() for t in {t for t, _ in pairs})
    assert told(nodes) == expected(pairs, largest)


@settings(max_examples=200, deadline=None)
@given(KEYS)
def test_spills_lose_nothing(pairs):
    trie, parts = PatriciaTrie(), []
    for n, (text, owner) in enumerate(pairs):
        trie.insert(text.encode(), owner)
        if n % 3 == 2:
            parts.extend((t.text[: t.end], t.size) for t in trie.spill_largest())
            assert trie.held == sum(len(t.text) for t in trie.terminals(trie.root))
    parts.extend((t.text[: t.end], t.size) for t in trie.spill_all())
    sums = defaultdict(int)
    for text, size in parts:
        sums[text.decode()] += size
    assert dict(sums) == {t: s[0] for t, s in expected(pairs, False).items()}


@settings(max_examples=200, deadline=None)
@given(KEYS)
def test_sorted_spills_are_complete(pairs):
    pairs = sorted(pairs, key=lambda p: p[0].encode())
    trie, found = PatriciaTrie(), []
    for text, owner in pairs:
        found.extend(trie.spill_before(text.encode()))
        trie.insert(text.encode(), owner)
    found.extend(trie.spill_all())
    assert len(found) == len({t for t, _ in pairs})
    assert told(found) == expected(pairs, False)


def brute(rows, largest):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = (max if largest else min)(real) if real else None
        taken = False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(docs, keep):
    got = sorted((tuple(r) for r in exact.members(docs, keep).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], keep == "largest")


def test_awkward_rows(spark):
    for keep in ("smallest", "largest"):
        check(awkward(spark), keep)
    check(awkward(spark).where("false"), "largest")


def test_small_budgets_spill(spark, monkeypatch):
    monkeypatch.setattr(exact, "HELD_BYTES", 50)
    monkeypatch.setattr(exact, "BATCH_BYTES", 40)
    rows = [(i, f"Text number {i % 17} " + "x" * (i % 5), "en", "s") for i in range(200)]
    check(documents(spark, rows), "largest")
    check(documents(spark, [(i, "One and the same", "en", "s") for i in range(300)]), "smallest")
