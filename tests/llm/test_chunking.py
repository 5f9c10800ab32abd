import random

import numpy as np
import pytest

from barloom.llm.chunking import Limits, split, split_documents
from barloom.llm.tokens import encoder, token_counts

SMALL = Limits(largest=64, overlap=8, least=24, landmark=16, span=4)


def prose(seed, sentences=80, alphabet="latin"):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop" if alphabet == "latin" else "中文测试段落句子发明装置"
    out = []
    for i in range(sentences):
        out.append((" " if alphabet == "latin" else "").join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(4, 14))) + (". " if alphabet == "latin" else "。"))
        if rng.random() < 0.15:
            out.append("\n\n")
    return "".join(out)


def check(text, limits):
    pieces = split(text, limits)
    enc = encoder()
    n = len(enc.encode_ordinary(text))
    if n <= limits.largest:
        assert pieces == []
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][1] == n and len(pieces) > 1
    rebuilt, ids = pieces[0][3], enc.encode_ordinary(text)
    for (a, b, _, _), (c, d, _, t) in zip(pieces, pieces[1:]):
        assert limits.overlap <= b - c <= limits.overlap + 3 and d > b
        rebuilt += t[len(enc.decode_bytes(ids[c:b]).decode()) :]
    assert rebuilt == text  # nothing lost, nothing twice but the overlap
    assert all(len(enc.encode_ordinary(t)) <= limits.largest for *_, t in pieces)
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_overlap_and_fit(seed):
    check(prose(seed), SMALL)
    check(prose(seed, alphabet="cjk"), SMALL)
    check(prose(seed, 400), Limits())


def test_awkward_texts():
    for t in ("", "a", "x" * 5000, "é" * 3000, "\n" * 4000, " " * 3000, "😀" * 800, "中" * 900, "word" + "́" * 2000):
        check(t, SMALL)


def test_cuts_are_natural_where_possible():
    pieces = check(prose(1, 300), SMALL)
    assert sum(k in ("paragraph", "sentence") for _, _, k, _ in pieces[:-1]) > 0.9 * (len(pieces) - 1)


def test_an_edit_moves_only_pieces_near_it():
    text = prose(7, 600)
    edited = "A new opening sentence stands here. " + text
    a, b = {t for *_, t in split(text, SMALL)}, {t for *_, t in split(edited, SMALL)}
    assert len(a & b) > 0.8 * len(a)
    middle = text[: len(text) // 2] + " changed words. " + text[len(text) // 2 :]
    assert len(a & {t for *_, t in split(middle, SMALL)}) > 0.8 * len(a)


def test_limits_are_checked():
    with pytest.raises(ValueError):
        Limits(largest=100, overlap=50, least=60)


def test_documents(spark):
    texts = [None, "", "short", prose(3, 300), prose(4, 300), "x " * 200_000]
    df = spark.createDataFrame([(i, t, 0, "p") for i, t in enumerate(texts)] + [(3, texts[3], 0, "p")], "doc_id long, text string, piece int, boundary string")
    out = split_documents(df, limits=SMALL)
    rows = out.collect()
    assert {r.doc_id for r in rows} == {3, 4, 5}
    four = sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.piece)
    assert [r.piece for r in four] == list(range(four[0].n_pieces)) and four[0].shared_tokens == 0 and all(8 <= r.shared_tokens <= 11 for r in four[1:])
    assert len([r for r in rows if r.doc_id == 3]) == 2 * len(split(texts[3], SMALL))
    assert split_documents(df.limit(0), limits=SMALL).count() == 0
    counts = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"]).collect()}
    assert counts[0] == counts[1] == 0 and counts[4] == len(encoder().encode_ordinary(texts[4]))
    assert np.all([r.end_token <= counts[r.doc_id] for r in rows])


def test_vocabulary_comes_with_the_job(spark, tmp_path):
    """The path the tasks are given exists on no executor, but a file of its name was sent."""
    import shutil

    from barloom.llm.tokens import VOCABULARY, ship_vocabulary, token_counts

    shutil.copy(VOCABULARY, tmp_path / "elsewhere.tiktoken")
    ship_vocabulary(spark, str(tmp_path / "elsewhere.tiktoken"))
    df = spark.createDataFrame([(1, "some words to count"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, token_counts(df, ["doc_id"], vocabulary="/nowhere/elsewhere.tiktoken").collect())) == sorted(map(tuple, token_counts(df, ["doc_id"]).collect()))
