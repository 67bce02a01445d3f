from tidewire.llm import licenses as LI


def brute(text, least):
    found = {}
    for line, passage in LI.passages(text or ""):
        grams = LI.bigrams(LI.words(passage))
        scored = [(2 * len(grams & t) / (len(grams) + len(t)), name) for t, name in ((LI.bigrams(LI.words(t)), n) for n, t in LI.TEMPLATES) if grams]
        top = max(scored, default=(0, ""))
        if top[0] >= least:
            found[line, top[1]] = max(found.get((line, top[1]), 0.0), top[0])
    return len(found), ",".join(sorted({n for _, n in found})), max(found.values(), default=0.0)


def test_pruning_loses_nothing(spark, awkward, empty):
    mit = LI.TEMPLATES[3][1]
    texts = ["Copyright (c) 2020 A. N. Other\n\n" + mit, "Some text.\nReleased under the MIT License.\nMore.", "x. Licensed under CC BY-NC 4.0. y",
             "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!", "Licensed under the Apache License", "licensed under", mit.upper() + " and a few more words",
             "This work is licensed under the GNU General Public License, version 2.", None, ""]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for least in (0.6, 0.9):
        got = LI.scan(docs, least=least).collect()
        assert sorted(str((r.doc_id, r.n_passages, r.licenses, r.max_dice)) for r in got) == sorted(
            str((r.doc_id, *brute(r.text, least))) for r in docs.collect())
    found = {r.doc_id: r for r in LI.scan(docs).collect()}
    assert [found[900 + i].licenses for i in range(4)] == ["MIT", "MIT", "CC-BY-NC-4.0", "Apache-2.0"] and found[907].licenses == "GPL-2.0"
    assert found[901].matches == "MIT:1:1000" and found[905].licenses == ""
    assert LI.scan(empty).count() == 0


def test_licences_inside_longer_documents(spark):
    mit = LI.TEMPLATES[3][1]
    a, b = mit.index("The above copyright"), mit.index("THE SOFTWARE IS")
    mit = f"{mit[:a]}\n\n{mit[a:b]}\n\n{mit[b:]}"
    apache = LI.TEMPLATES[5][1]
    x, y = apache.index("http"), apache.index(" Unless")
    apache = f"{apache[:x]}\n\n    {apache[x:y]}\n\n{apache[y:]}"
    prose = "\n".join(f"Line {i} of a long story about number{i} and number{i + 1}." for i in range(80))
    wrapped = "Some words first. Released under\nthe MIT License. And then some more words that go on."
    full = [(n, t) for n, t in LI.TEMPLATES if len(t) > 5000]
    texts = [f"{prose}\n\n{mit}\n\n{prose}", f"{prose}\n\n{apache}\n\n{prose}", f"{prose}\n{wrapped}\n{prose}", prose, *[f"{prose}\n{t}\n{prose}" for _, t in full]]
    got = {r.doc_id: r for r in LI.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].matches.startswith("MIT:81:") and got[0].licenses == "MIT"
    assert got[1].licenses == "Apache-2.0" and "Apache-2.0:81:" in got[1].matches
    assert got[2].matches == "MIT:80:1000" and got[3].n_passages == 0
    assert {n for n, _ in full} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"}
    assert all(n in got[4 + i].licenses.split(",") for i, (n, _) in enumerate(full))
    bsd = next(t for n, t in LI.TEMPLATES if n == "BSD-2-Clause" and t.endswith("SUCH DAMAGE."))
    one = LI.scan(spark.createDataFrame([(1, f"{prose}\n{bsd}\n{prose}")], "doc_id long, text string")).collect()[0]
    assert one.matches == "BSD-2-Clause:80:1000"
