"""near_copies against all pairs: large families, texts of few words, texts just at four fifths."""

import random

import numpy as np
import pytest

from tracelode.llm import simhash as S


def all_pairs(rows):
    """Components by exact shares of five-word shingles, the sets as rows of a matrix."""
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    place = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(place)), np.float32)
    for k, one in enumerate(sets):
        has[k, [place[s] for s in one]] = 1
    common, size = has @ has.T, has.sum(axis=1)
    near = 9 * common >= 4 * (size[:, None] + size[None, :])
    label = np.array([i for i, _ in rows])
    while (after := np.where(near, label[None, :], 1 << 60).min(axis=1)).tolist() != label.tolist():
        label = after
    return {i: int(c) for (i, _), c in zip(rows, label, strict=True)}, near


def family(rng, base, size, edits):
    out = []
    for _ in range(size):
        w = list(base)
        for at in rng.sample(range(len(w)), edits):
            w[at] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def found(spark, rows):
    return dict(S.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())


@pytest.mark.parametrize("words, edits", [(110, 2)])
def test_a_family_of_hundreds_of_different_copies(spark, words, edits):
    rng = random.Random(words + edits)
    texts = family(rng, [f"w{i}" for i in range(words)], 300, edits)
    # Each has some edits of its own and is near some of the others only.
    texts += [t + " " + " ".join(f"e{k % 7}y{j}" for j in range(k % 12)) for k, t in enumerate(texts[:100])]
    rows = list(enumerate(texts))
    want, near = all_pairs(rows)
    assert 1 < len(set(want.values())) and near.sum() > len(rows)
    assert found(spark, rows) == want


def test_pairs_just_at_four_fifths_of_texts_of_any_length(spark):
    rng, rows = random.Random(5), []
    word = lambda: f"v{rng.randrange(10**9)}"
    for n in [*range(8, 31)] * 12 + [60, 120, 184, 400] * 12:
        base = [word() for _ in range(n)]
        shingles = n - 4
        # So many words more that the share is 0.80 to 0.86.
        for more in {round(shingles / share) - shingles for share in (0.8, 0.83, 0.86)}:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + [word() for _ in range(more)]))]
    want, near = all_pairs(rows)
    assert (near.sum() - len(rows)) > 600
    assert found(spark, rows) == want


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "_copy_of_text", "_gone_id", "_gone_copy", "root", "fp"]
    rows = [(1, "a b c d e f", 7, 8, 9, "r", 1), (2, "a b c d e f", 7, 8, 9, "r", 2), (3, "quite another one here now", None, None, None, None, None)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _copy_of_text int, _gone_id int, _gone_copy int, root string, fp int"))
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_one_of_texts_with_near_fingerprints_stays(spark):
    """Most words of a pair are one line again and again, so fingerprints are equal and shares of different shingles low."""
    line = "one two three four five six seven "
    rows = [(1, line * 200 + " ".join(f"a{i}" for i in range(40))), (2, line * 200 + " ".join(f"b{i}" for i in range(40))), (3, " ".join(f"c{i}" for i in range(40))), (4, " ".join(f"d{i}" for i in range(40))), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}
    assert names == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert dict(S.near_copies(docs).collect())[2] == 2
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [1, 3, 4, 5]
