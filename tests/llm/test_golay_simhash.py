"""SimHash near duplicates by Golay-code fuzzy hashing."""

import re

import numpy as np
import pytest
import xxhash

from cairnspark.llm import golay_simhash as g
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _print(text: str | None) -> int:
    words = WORD.findall(_lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints: list[int]) -> list[int]:
    """For each print the first place of its component, by walking over all pairs."""
    place = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and place[i] != place[j]:
                a, b = sorted((place[i], place[j]))
                place = [a if p == b else p for p in place]
    return place


def test_every_word_is_within_three_bits_of_its_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 20_000)
    s = g.syndrome(words)
    code = words ^ g._ERROR[s]
    assert (g.syndrome(code) == 0).all() and np.bitwise_count(g._ERROR[s]).max() == 3
    far = np.bitwise_count(g._ERROR[s]) == 3
    others = (g._FARTHER[s][far] ^ (code[far] >> 11)[:, None]) << 11
    others = others | g._REST[others >> 11]
    assert (np.bitwise_count(others ^ words[far][:, None]) == 4).all() and all(len(set(x)) == 5 for x in others[:500].tolist())


def test_prints_within_three_bits_share_a_key():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 64, 6000, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 4)), replace=False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    keys = [[set() for _ in a] for _ in range(2)]
    for side, prints in enumerate((a, b)):
        for row, key in zip(*(x.tolist() for x in g.fingerprint_keys(prints)), strict=True):
            keys[side][row].add(key)
    assert all(x & y for x, y in zip(*keys, strict=True))
    assert np.mean([len(x) for x in keys[0]]) < 40


def test_prints_are_those_of_the_definition(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = g.simhash_classes(odd_docs).collect()
    assert sorted((str(r.doc_id), f"{_print(r.text):016x}") for r in rows) == sorted((str(r.doc_id), r.fingerprint) for r in got)
    assert {r.fingerprint for r in got if r.doc_id in (4, 5, 6)} == {"0" * 16}


@pytest.mark.parametrize("block", [g.BLOCK, 4])
def test_components_are_those_of_all_pairs(spark, sf_dir, odd_docs, block):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text")
    near = [prose(5, 150).split() for _ in range(60)]
    for k, words in enumerate(near):
        words[k + 20] = "changed"
    planted = spark.createDataFrame([(10**6 + k, " ".join(w)) for k, w in enumerate(near)], "doc_id bigint, text string")
    for table in (docs.unionByName(planted), odd_docs):
        got = g.simhash_classes(table, block=block).collect()
        prints = [int(r.fingerprint, 16) for r in got]
        ids = {}
        place = _classes(prints)
        for r, p in zip(got, place, strict=True):
            if r.doc_id is not None:
                ids[p] = min(ids.get(p, r.doc_id), r.doc_id)
        assert [r.component_id for r in got] == [ids.get(p) for p in place]


def test_large_tasks_leave_a_forest_only():
    r = np.random.default_rng(3)
    tight = np.uint64(12345) ^ np.array([1 << int(a) | 1 << int(b) for a, b in r.integers(0, 64, (500, 2))], np.uint64)
    loose = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    prints = np.unique(np.concatenate([tight, loose]))
    links = np.concatenate(list(g._walk(prints)), axis=1)
    assert links.shape[1] < len(prints) and (np.bitwise_count(links[0] ^ links[1]) <= 3).all()
    parent = {p: p for p in prints.tolist()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links.T.tolist():
        parent[root(a)] = root(b)
    place = _classes(prints.tolist())
    assert len({root(p) for p in parent}) == len(set(place))


def test_empty_table(no_docs):
    assert g.simhash_classes(no_docs).count() == 0
