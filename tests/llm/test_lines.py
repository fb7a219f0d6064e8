import hashlib
import random

import pytest

from vulnloom.llm import lines


def plain(rows):
    """All pairs of different lines by exact similarity, then components."""
    every, where = [], {}
    for doc, text in rows:
        for no, line in lines.judged((text or "").encode()):
            where.setdefault(line, []).append((doc is not None, doc or 0, no))
    every = list(where)
    sets = [lines.shingles(x) for x in every]
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(every)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    first = {}
    for i, line in enumerate(every):
        first[find(i)] = min([*where[line], *([first[find(i)]] if find(i) in first else [])])
    of = {line: first[find(i)] for i, line in enumerate(every)}
    out = []
    for doc, text in rows:
        gone = {no for no, line in lines.judged((text or "").encode()) if of[line] != (doc is not None, doc or 0, no)}
        parts = (text or "").encode().split(b"\n")
        kept = b"\n".join(x for no, x in enumerate(parts) if no not in gone)
        out.append((doc, len(parts), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiouélmnrst") for _ in range(rng.randrange(2, 9)))
    bases = [[word() for _ in range(rng.choice([1, 3, 12, 40, 120]))] for _ in range(25)]
    rows = []
    for i in range(90):
        text = []
        for _ in range(rng.randrange(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = word()
            text.append(rng.choice(["", " "]) + rng.choice([" ", "  "]).join(line))
        rows.append((i, "\n".join(text)))
    return rows + [(None, rows[5][1]), (200, None), (201, ""), (202, "\n \n"), (7, rows[7][1]), (8, "abc"), (203, "abc"), (204, "x" * 20000 + "\n" + "x" * 20001)]


@pytest.mark.parametrize("chunk", [10**6, 500])
def test_lines_go_as_by_brute_force(spark, monkeypatch, chunk):
    """Whatever goes has an earlier similar line; of what the brute force removes nearly all goes."""
    monkeypatch.setattr(lines, "CHUNK_BYTES", chunk)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_chars long, gone string").repartition(3)
    got = {(r["doc_id"], r["n_lines"]): r for r in lines.dedup_lines(docs).collect()}
    want = plain(rows)
    assert len({r[:2] for r in want}) == len(got)
    assert all(got[r[:2]]["n_removed"] <= r[2] for r in want)
    assert sum(got[r[:2]]["n_removed"] for r in want) >= 0.97 * sum(r[2] for r in want)
    assert all(got[r[:2]]["kept_sha256"] == r[3] for r in want if got[r[:2]]["n_removed"] == r[2])
    if chunk == 500:
        left = lines.without_repeated_lines(docs)
        assert left.columns == docs.columns
        kept = left.collect()
        assert sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept) == sorted(
            (str(r["doc_id"]), r["kept_sha256"]) for r in lines.dedup_lines(docs).collect())
        assert all(r["n_chars"] == len(r["text"]) for r in kept if r["text"] is not None)


def families(n, of, chars):
    """``n`` lines that are not similar, and ``of`` - 1 more that are similar to each."""
    rng = random.Random(7)
    out = []
    for _ in range(n):
        line = [rng.choice("abcdefghijklm ") for _ in range(chars)]
        out.append([("".join(line[:-i or None]) + "z" * i).encode() for i in range(of)])
    return out


def test_a_bucket_with_many_kinds_of_lines(spark):
    """All lines of one bucket: none is left out when the leaders are similar to few of them."""
    groups = families(12, 4, 200)
    columns = [c.split()[0] for c in lines.LINES.split(", ")]
    rows = [{"key": 100 * g + i, "d": 100 * g + i, "k": 0, "no": 0, "bands": [1], "line": line} for g, group in enumerate(groups) for i, line in enumerate(group)]
    table = spark.createDataFrame([tuple(r.get(c, False) for c in columns) for r in rows], lines.LINES)
    got = {(r["node"], r["component"]) for r in lines.links(table).collect()}
    assert got == {(100 * g + i, 100 * g) for g in range(12) for i in range(4)}


def test_pairs_of_the_prefixes_are_all_similar_pairs(spark):
    rng = random.Random(11)
    some = sorted({x for group in families(8, 9, 60) for x in group} | {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(150)})
    sets = [lines.shingles(x.decode().encode()) for x in some]
    want = {(i, j) for i in range(len(some)) for j in range(i + 1, len(some)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    texts = spark.createDataFrame(list(enumerate(some)), "key long, line binary")
    got = {(r["a"], r["b"]) for r in lines.verified(lines.undecided_pairs(texts, None), texts).collect()}
    assert len(want) > 100 and got == want


def test_short_similar_lines_always_meet(spark):
    """Of pairs of any small length that are similar, with or without repeated shingles, the later line goes."""
    rng = random.Random(5)
    pairs = []
    for chars in [*range(12, 66)] * 3:
        line = "".join(rng.choice("abcdefghijklm") for _ in range(chars))
        pairs.append((line, line[:-max(1, (chars - 7) // 10)] + "z" * max(1, (chars - 7) // 10)))
    for _ in range(20):
        unit = "".join(rng.choice("abcdefgh") for _ in range(12))
        pairs.append((unit * 12, unit * 12 + "z"))
    sets = [(lines.shingles(a.encode()), lines.shingles(b.encode())) for a, b in pairs]
    similar = [5 * len(a & b) >= 4 * len(a | b) for a, b in sets]
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()}
    assert sum(similar) > 100 and all(got[i] >= s for i, s in enumerate(similar))


def test_lines_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, lines.dedup_lines(docs).collect()), key=str) == plain(rows)


def test_shingle_hashes_match_sets():
    some = ["abcdefgh", "abc", "ééabcdefghi", "a" * 30, "aaaaaaaaa"]
    hashes, line = lines.shingle_hashes([x.encode() for x in some])
    for i, text in enumerate(some):
        assert len(set(hashes[line == i].tolist())) == len(lines.shingles(text.encode()))
    assert set(hashes[line == 3].tolist()) == set(hashes[line == 4].tolist())


def test_band_recall():
    rng = random.Random(1)
    met = near = 0
    for _ in range(300):
        text = "".join(rng.choice("abcdefghij ") for _ in range(400))
        cut = list(text)
        for at in rng.sample(range(400), 4):
            cut[at] = rng.choice("klmnop")
        a, b = text.encode(), "".join(cut).encode()
        one, two = lines.shingles(a), lines.shingles(b)
        if len(one & two) / len(one | two) >= 0.8:
            near += 1
            x, y = lines.signatures([a, b])
            met += bool((x == y).any())
    assert near > 100 and met >= 0.98 * near


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_of_a_large_group_meet_few_others_first(spark):
    """300 lines with the same frequent shingles: the first round makes a few pairs a line, of those that the exact join makes."""
    draw = random.Random(12)
    sign = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = sign(200)
    texts = spark.createDataFrame([(k, (common + sign(20)).encode()) for k in range(300)], "key long, line binary")
    whole = {tuple(sorted(r)) for r in lines.undecided_pairs(texts, None).collect()}
    few = {tuple(sorted(r)) for r in lines.undecided_pairs(texts, None, lines.prefixes(texts), lines.PARTNERS).collect()}
    assert len(whole) == 300 * 299 // 2 and few < whole and len({x for pair in few for x in pair}) >= 299  # the largest component does not look for others
    assert len(few) <= 300 * 2.5 * lines.PARTNERS
    assert lines.undecided_pairs(texts.limit(2 * lines.PARTNERS), None, None, lines.PARTNERS).isEmpty()
