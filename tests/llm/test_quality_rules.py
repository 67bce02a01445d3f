import re
from collections import Counter

from tidewire.llm import quality_rules as QR


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_equal_brute_force(awkward, empty):
    got = QR.quality_rules(awkward).collect()
    assert sorted(str((r.doc_id, *r[1:7])) for r in got) == sorted(str((r.doc_id, *brute(r.text))) for r in awkward.collect())
    assert not any(r.kept and r.base_failed for r in got)
    assert QR.quality_rules(empty).count() == 0


def test_thresholds_follow_language_and_source(spark):
    def doc(i, symbols):
        words = [f"word{i}n{j}" for j in range(100)]
        for j in range(symbols):
            words[j] += "#" * 8
        return " ".join(words)

    # source a writes many symbols, source b none: each is judged by its own fences
    rows = [(i, doc(i, 20 + i % 5), "en", "a") for i in range(60)] + [(100 + i, doc(i, 0), "en", "b") for i in range(60)]
    rows += [(500, doc(500, 22), "en", "b"), (501, doc(501, 0), "en", "a"), (502, doc(502, 0), "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in QR.quality_rules(docs, QR.Rules(min_group=30)).collect()}
    assert all(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(60)) and not kept[500] and kept[501] and 502 in kept
