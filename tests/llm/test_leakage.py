import random
import unicodedata

import pytest

from barloom.llm.leakage import Items, cut_leaks, find_leaks, normalise, remove_leaks, words_of

DOCS, ITEMS = "doc_id long, text string, item_id string, _k int", "item_id long, item_text string, doc_id int, task string"


def test_normalise():
    assert words_of("The ﬁrst co­operative​ X²-ray") == ["the", "first", "cooperative", "x2", "ray"]
    assert words_of("exam-\n  ple well-known end- \r\nless A-1 b-\n-c 5-\n6") == ["example", "well", "known", "endless", "a", "1", "b", "c", "56"]
    assert normalise("") == "" and words_of("中文,测试 ＡＢ") == ["中文", "测试", "ab"]
    assert words_of("a_b") == ["a", "b"]


def brute(docs, items, n=12):
    out = set()
    for d, text, *_ in docs:
        w = words_of(text or "")
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, t, *_ in items:
            v = words_of(t or "")
            if any(tuple(v[j : j + n]) in grams for j in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([5, 12, 13, 40])), 0, "t") for i in range(20)] + [(90, None, 0, "t"), (91, "", 0, "t")]
    items.append((92, items[3][1] + " tail of it", 0, "t"))
    docs = [(1000, None, "", 0), (1001, "", "", 0)]
    for d in range(150):
        w = text(rng.randrange(0, 200)).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            v = (rng.choice(items)[1] or "").split()
            k = rng.choice([11, 12, 13, 40])
            a = rng.randrange(max(len(v) - k, 0) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in v[a : a + k]]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w), "", 0))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scan_matches_brute_force(seed):
    docs, items = make(seed)
    known = Items([(i, t) for i, t, *_ in items])
    got = {(d, i) for d, t, *_ in docs for i in known.hits(words_of(t or ""))}
    assert got == brute(docs, items) and got


def windows(text, item, n=12):
    w, v = words_of(text or ""), words_of(item or "")
    grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
    return sum(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1))


@pytest.mark.parametrize("limit", [8 << 20, 1500])
def test_items_in_any_number_of_blocks_give_the_same(spark, limit):
    docs, items = make(4)
    docs.append(docs[5])  # a repeated row is reported again
    found = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), max_item_chars=limit)
    assert found.columns == ["doc_id", "item_id", "n_grams"]
    want = sorted((d, i, k) for d, t, *_ in docs for i, u, *_ in items if (k := windows(t, u)))
    assert sorted(map(tuple, found.collect())) == want and {r[:2] for r in want} == brute(docs, items)


def test_windows_between_touching_spans_do_not_count(spark):
    words = [f"u{i}" for i in range(40)]
    d = spark.createDataFrame([(1, " ".join(words[:12] + words[20:32]), "", 0)], DOCS)
    i = spark.createDataFrame([(7, " ".join(words), 0, "")], ITEMS)
    assert [r.n_grams for r in find_leaks(d, i).collect()] == [2] and remove_leaks(d, i).first().n_spans == 1


def test_a_hash_collision_is_no_hit():
    class Blind(Items):
        def _hashes(self, words):
            import numpy as np

            return np.zeros(max(len(words) - self.n + 1, 0), dtype=np.uint64)

    docs, items = make(6)
    rows = [(i, t) for i, t, *_ in items]
    a, b = Items(rows), Blind(rows)
    assert all(a.hits(words_of(t or "")) == {k: v for k, v in b.hits(words_of(t or "")).items()} for _, t, *_ in docs[:40])


def test_cut_leaves_no_leak_and_the_rest_alone(spark):
    docs, items = make(5)
    known = Items([(i, t) for i, t, *_ in items])
    for _, t, *_ in docs:
        cut, n = cut_leaks(t or "", known, 1.0)
        assert (n == 0) == (not known.hits(words_of(t or "")))
        assert cut is not None and (n or cut == (t or ""))
        if n:
            assert len(words_of(cut)) < len(words_of(t))
    out = remove_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert len(out) == len(docs) and {r.action for r in out} == {"kept", "cut", "dropped"}
    assert all((r.text is None) == (r.action == "dropped" or r.doc_id == 1000) for r in out)
    for limit in (1500,):
        again = remove_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), max_item_chars=limit)
        assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_cut_with_composed_and_broken_words():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda muon"
    known = Items([(1, item)])
    text = "Vor é ﬁx. " + item.replace("gamma", "gam-\n ma").replace("zeta", "ze­ta").upper() + " Ende é."
    cut, n = cut_leaks(unicodedata.normalize("NFD", text), known, 1.0)
    assert n == 1 and words_of(cut) == words_of("Vor é ﬁx. Ende é.")


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert find_leaks(d, i).count() == 0 and find_leaks(spark.createDataFrame([(1, "a " * 50, "", 0)], DOCS), i).count() == 0
    assert remove_leaks(d, i).count() == 0


def test_very_long_text_is_scanned_whole(spark):
    item = " ".join(f"t{i}" for i in range(12))
    d = spark.createDataFrame([(1, "filler words here " * 100_000 + item, "", 0)], DOCS)
    assert [r.item_id for r in find_leaks(d, spark.createDataFrame([(7, item, 0, "")], ITEMS)).collect()] == [7]
