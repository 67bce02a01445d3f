import hashlib
import random
import re

from tidewire.llm import personal_data as PD

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 if d > 4 else d * 2 for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    found = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 10 <= len(digits) <= 15 or kind == "email"):
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_base_spans_equal_the_patterns(spark, awkward, empty):
    rng = random.Random(2)
    rows = [(1000 + i, "".join(rng.choice("a1.@+- (é)5\U0001f600_0\n9") for _ in range(120))) for i in range(600)]
    rows += [(1, "1 2" * 5000), (2, "a" * 50_000 + "@"), (3, "x@y" + ".z" * 5000), (4, "1" * 20_000), (5, "a@b.c_d@e.f x 4111111111111111, +1 (171) 555-2028 300.1.1.1 é 10.0.0.255"),
             (6, "0010.1.1.1 1.2.3.4.5 4111 1111 1111 1111")]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = PD.personal_data(docs).collect()
    key = lambda d, b, n: str((d, hashlib.sha256(",".join(b).encode()).hexdigest(), n))
    assert sorted(key(r.doc_id, base(r.text), [sum(s.startswith(k) for s in base(r.text)) for k, _ in KINDS]) for r in docs.collect()) == sorted(
        str((r.doc_id, r.base_sha256, [r.n_email, r.n_ip, r.n_card, r.n_phone])) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert set(base(rows[-2][1])) <= set(by_id[5].spans.split(","))
    assert PD.personal_data(empty).count() == 0


def test_other_spans_need_support(spark):
    rows = [(i, f"mail me: user{i}@site.com or call +1 212 555 01{i % 90 + 10}, server 10.0.{i % 250}.7") for i in range(300)]
    rows += [(500, "please call (212) 555-7890 today"), (501, "chapter 12-34 of version 1.2, page 555-1234-99"), (502, "bob [at] site [dot] com is my mail")]
    got = {r.doc_id: r.spans for r in PD.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[500] == "phone:12:26" and got[501] == "" and all(len(got[i].split(",")) == 3 for i in range(300))


def test_reliabilities():
    rows = [{"kind": "phone", "pattern": a, "gazetteer": b, "cue": c, "glued": 0, "size": 1, "n": n}
            for a, b, c, n in ((1, 1, 1, 500), (1, 1, 0, 400), (-1, -1, 0, 300), (-1, 1, -1, 200), (0, 1, 1, 50), (0, -1, -1, 50))]
    model = PD.fit(rows)
    good, bad = model.reliability["pattern"][1], model.reliability["pattern"][0]
    assert good[2] > bad[2] and bad[0] > good[0] and model.weights["gazetteer", 1] > model.weights["gazetteer", -1]
    assert PD.fit([]).weights == {("bias", 0): -4.0}
