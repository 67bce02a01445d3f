import random
import re
import struct
from collections import defaultdict

import xxhash

from tidewire.llm import line_dedup as LD

RULES = LD.Chunks(long_line=25, one_in=3, least=10)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chunks(text, rules):
    lines = text.split("\n")
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    h = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in lines]
    cuts = [0]
    for i in range(1, len(lines)):
        both = xxhash.xxh64(struct.pack("<q", h[i]), seed=xxhash.xxh64(struct.pack("<q", h[i - 1]), seed=42).intdigest()).intdigest()
        if count[i - 1] >= rules.long_line or count[i] >= rules.long_line or signed(both) % rules.one_in == 0:
            cuts.append(i)
    return [("\n".join(lines[a:b]), sum(count[a:b])) for a, b in zip(cuts, cuts[1:] + [len(lines)])]


def brute(rows, rules):
    number, first = defaultdict(int), {}
    for d, t in {(d, t) for d, t in rows}:
        for c, w in chunks(t, rules) if t is not None else []:
            if w >= rules.least:
                number[c] += 1
                first[c] = min(x for x in (first.get(c), d) if x is not None) if d is not None or first.get(c) is not None else None
    again = defaultdict(int)
    for d, t in rows:
        for c, w in chunks(t, rules) if t is not None else []:
            again[c] += w >= rules.least
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        kept, seen, gone = [], set(), 0
        for c, w in chunks(t, rules):
            if w >= rules.least and again[c] > 1 and (c in seen or first[c] != d):
                gone += 1
            else:
                kept.append(c)
            seen.add(c)
        out.append((d, "\n".join(kept) if gone else t, gone))
    return out


def test_equals_brute_force(spark, awkward):
    lines = [" ".join(f"v{(i * 7 + j) % 50}" for j in range(1 + i % 40)) for i in range(60)]
    rows = [(i, "\n".join(lines[(i * k) % 60] for k in range(1, 2 + i % 9))) for i in range(80)]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = LD.line_dedup(docs, RULES).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], RULES)
    assert sorted(str((r.doc_id, r.text, r.n_removed_)) for r in got) == sorted(map(str, want))
    assert any(r.n_removed_ for r in got)


def test_borders_withstand_shifts(spark):
    passage = "\n".join(f"line {i} of a shared passage with a few words" for i in range(30))
    docs = spark.createDataFrame([(1, "start\n" + passage + "\nend"), (2, "other words\nbefore it\n" + passage), (3, passage + "\nafter")], "doc_id long, text string")
    got = {r.doc_id: r for r in LD.line_dedup(docs, RULES).collect()}
    assert got[1].n_removed_ == 0 and all(len(got[i].text) < 0.35 * len(passage) for i in (2, 3))
    assert "other words" in got[2].text and "after" in got[3].text


def test_columns_and_empty_tables(awkward, empty):
    got = LD.line_dedup(awkward)
    assert got.columns == [*awkward.columns, "n_chunks_", "n_removed_"] and got.count() == awkward.count()
    assert LD.line_dedup(empty).count() == 0


def test_planted_passages_of_short_lines_go(spark):
    """Passages of 50 to 100 words in lines of any length, between short lines, with the parameters of the query."""
    rng = random.Random(3)

    def line(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    passages = [[line(w) for _ in range(n)] for n, w in [(6, 10), (3, 20), (10, 10), (2, 30), (4, 24)] * 12]
    whole = [(i, p, [line(4), *p, line(5)]) for i, p in enumerate(passages)]
    rows = [(i, "\n".join(x)) for i, _, x in whole]
    rows += [(100 + i, "\n".join(["", line(3), p[0], "", *p[1:], line(6), line(2)])) for i, p, _ in whole]
    rows += [(200, "\n".join(passages[0] + [line(7)] + passages[0])), (201, passages[1][0] + "\n" + passages[1][1][:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in LD.line_dedup(docs).collect()}
    text = dict(rows)
    assert all(got[i] == text[i] for i in range(len(passages)))                                      # the first place stays
    for i, p, _ in whole:
        kept = text[100 + i].split("\n")
        assert got[100 + i].split("\n") == kept[:2] + kept[-2:]
    assert got[200] == text[200].split("\n")[6] and got[201] == text[201]                            # under 25 words stays


def test_no_line_is_lost(spark):
    rng = random.Random(4)
    pool = [" ".join(f"p{i}x{j}" for j in range(rng.randrange(1, 30))) for i in range(40)]
    rows = [(rng.randrange(60) if i % 9 else None, "\n".join(rng.choice(["", *pool[i:i + 5]]) for i in (rng.randrange(36) for _ in range(rng.randrange(1, 40)))))
            for i in range(80)]
    rows += rows[:7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = LD.line_dedup(docs).collect()
    assert {x for _, t in rows for x in t.split("\n") if x} == {x for r in got for x in r.text.split("\n") if x}
    assert len(got) == len(rows) and any(r.n_removed_ for r in got)
