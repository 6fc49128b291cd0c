"""Best-fit packing: every word once, bins within capacity, no worse than simple rules."""

import random

import numpy as np
import pytest
from tables import docs, messy, words

from wordloom.llm import packing


def naive_best_fit(sizes, opening):
    rooms, where = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            room = min(r for r, _ in fits)
            i = [i for r, i in fits if r == room][-1]
        else:
            i = len(rooms)
            rooms.append(opening(s))
        rooms[i] -= s
        where.append(i)
    return sorted(rooms), len(rooms)


def test_fit_takes_the_least_sufficient_room():
    r = random.Random(1)
    sizes = sorted((r.randint(1, 60) for _ in range(400)), reverse=True)
    where, opened = packing.fit(sizes, lambda s: 64)
    left = np.array(opened) - np.bincount(where, weights=sizes, minlength=len(opened))
    assert (sorted(left.tolist()), len(opened)) == naive_best_fit(sizes, lambda s: 64)


def test_pack_is_no_dearer_than_one_length_and_downsizes():
    r = random.Random(2)
    sizes = np.array(sorted((int(r.paretovariate(1.1) * 20) % 900 + 1 for _ in range(2000)), reverse=True))
    lengths = [128, 256, 512, 1024]
    bins, length = packing.pack(sizes, lengths, float)
    filled = np.bincount(bins, weights=sizes)
    assert (filled <= length).all()
    assert all(length[i] == min(x for x in lengths if x >= filled[i]) for i in range(len(length)))
    for c in (1024,):
        where, opened = packing.fit(sizes.tolist(), lambda s: c)
        assert length.sum() <= len(opened) * c
    assert length.sum() <= 1.05 * sizes.sum()


@pytest.mark.parametrize("shard_items", [8192, 3])
def test_round_trip(spark, shard_items):
    rows = messy()
    lengths = (16, 64, 256, 1024)
    got = packing.pack_documents(docs(spark, rows), lengths, shard_items=shard_items).toPandas()
    need = sorted(len(words(t)) + 1 for _, t in rows if words(t))
    whole = got.assign(id=got["id"].fillna(-1)).groupby(["id", "piece", "start"], as_index=False).agg(n=("size", "size"), size=("size", "sum"))
    assert got["size"].sum() == sum(need)
    assert set(got["id"].dropna().astype(int)) | {-1} == {(-1 if i is None else i) for i, t in rows if words(t)}
    assert (got["start"] == got["piece"] * 1024).all() and (got["size"].between(1, 1024)).all() and whole["n"].max() >= 2
    for _, b in got.groupby("bin"):
        b = b.sort_values("place")
        assert b["bin_length"].nunique() == 1 and b["bin_length"].iloc[0] in lengths
        assert (b["place"].to_numpy() == np.concatenate([[0], b["size"].cumsum().to_numpy()[:-1]])).all()
        assert b["size"].sum() <= b["bin_length"].iloc[0]


def test_empty_table_and_bad_lengths(spark):
    assert packing.pack_documents(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(docs(spark, []), lengths=())
