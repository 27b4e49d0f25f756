import re
from collections import Counter

from pyspark.sql import functions as F

from tidelog.llm.quality import METRICS, base_failed, metric_columns, quality_rules, rule_counts, sketches, thresholds

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts(spark, documents, odd_documents):
    extra = spark.createDataFrame([(1, "a b c d e a b c d e"), (2, "a a a a a a a a"), (3, "x\nx\n\n \nx y\nx"), (4, "🙂#|\x0b<&"), (5, "p q r s t p q r s t z p q r s t")], "doc_id long, text string")
    for df in (documents, odd_documents, extra):
        rows = rule_counts(df.select("doc_id", "text")).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert tuple(r[c] for c in COLUMNS) == brute(r["text"]), r["text"]


def test_verdicts(spark, odd_documents):
    got = quality_rules(odd_documents).collect()
    assert len(got) == 9
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert quality_rules(odd_documents.limit(0)).count() == 0


def quartiles(values):
    ordered = sorted(values)
    return [ordered[-(-q * len(ordered) // 4) - 1] for q in (1, 2, 3)]


def rounded(n):
    """The four leading bits."""
    shift = max(0, n.bit_length() - 4)
    return n >> shift << shift


def test_thresholds_follow_the_group(spark, documents):
    counts = rule_counts(documents)
    columns = [v.alias(m) for m, v in metric_columns().items()]
    values = counts.where(~base_failed()).select("lang", "n_lines", F.col("n_words"), *columns).collect()
    for r in thresholds(sketches(counts), ["lang"]).collect():
        mine = [v for v in values if v["lang"] == r["lang"]]
        of = {m: quartiles(v[m] for v in mine) for m in METRICS}
        lines, words, length = quartiles(rounded(v["n_lines"]) for v in mine)[1], quartiles(rounded(v["n_words"]) for v in mine)[1], of["length"][1]
        least = {"symbols": 10000 // (3 * length), "length": length // 2, "lines": 3000 // lines, "repeats": 30000 // words}
        for m in METRICS:
            q1, _, q3 = of[m]
            away = max(3 * (q3 - q1), least[m])
            assert (r["n"], r[m]["low"], r[m]["high"]) == (len(mine), q1 - away, q3 + away)


def test_every_metric_adapts(spark):
    """Two languages with other word lengths, line counts and sizes have other thresholds for all four metrics."""
    text = lambda i, words, lines, size: "\n".join(" ".join(f"{i}x{n}y{j}".ljust(size, "z") for j in range(words)) for n in range(lines))
    rows = [(i, text(i, 8, 4 + i % 2, 6), "a", "s") for i in range(60)] + [(100 + i, text(i, 20, 12 + i % 3, 14), "b", "s") for i in range(60)]
    counts = rule_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    a, b = thresholds(sketches(counts), ["lang"]).orderBy("lang").collect()
    assert all(a[m]["high"] != b[m]["high"] for m in METRICS)


def test_outliers_of_their_group_go_and_others_stay(spark):
    clean = [(i, " ".join(f"word{j * (i % 90 + 1) % 97}" for j in range(60)), "en", "a") for i in range(150)]
    noisy = [(1000 + i, " ".join(f"|w#{j * (i % 90 + 3) % 101}" for j in range(60)), "en", "a") for i in range(5)]
    other = [(2000 + i, " ".join(f"|w#{j * (i % 90 + 3) % 101}" for j in range(60)), "xx", "b") for i in range(150)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(clean + noisy + other, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[r[0]] for r in clean + other) and not any(got[r[0]] for r in noisy)


def test_groups_of_long_words_have_fences_of_their_own(spark):
    """Mean lengths of 45 to 74 characters, and outliers that a cut at 40 turned round."""
    text = lambda i, n: " ".join(f"{i:04d}{j:02d}".ljust(n, "x") for j in range(20))
    clean = [(i, text(i, 45 + i % 30), "zh", "a") for i in range(300)]
    near = [(1000 + i, text(i, n), "zh", "a") for i, n in enumerate((30, 36))]
    far = [(2000 + i, text(i, n), "zh", "a") for i, n in enumerate((500, 5000))]
    rows = quality_rules(spark.createDataFrame(clean + near + far, "doc_id long, text string, lang string, source string")).collect()
    got = {r["doc_id"]: (r["kept"], r["failed"]) for r in rows}
    assert all(got[r[0]] == (True, "") for r in clean + near) and all(got[r[0]] == (False, "length") for r in far)
