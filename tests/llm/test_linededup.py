import hashlib
import re

import pytest

from tidelog.llm.linededup import remove_repeated_units, units


def brute(rows, kind, least):
    seen, order = {}, sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    out = {}
    # among one id, texts rank by their hash, which the test's data don't need
    for null, i, text in order:
        kept, gone, at = [], [], 0
        found = units(text, kind)
        for n, (a, b) in enumerate(found):
            plain = " ".join(text[a:b].lower().split())
            if len(plain.split()) >= least and plain in seen:
                gone.append(f"{a}:{b}")
                kept.append(text[at:a])
                at = found[n + 1][0] if n + 1 < len(found) else b
            seen.setdefault(plain, 1)
        rest = "".join([*kept, text[at:]])
        out[None if null else i, text] = (len(found) if text else 0, len(gone), ",".join(gone), rest, hashlib.sha256(rest.encode()).hexdigest())
    holders = {}
    for r in set((i, t or "") for i, t in rows):
        for words in sentence_runs(r[1], 20):
            holders.setdefault(words, set()).add(r)
    shared = {r for held in holders.values() if len(held) > 1 for r in held}
    return sorted(((r[0], *out[r[0], r[1] or ""], (r[0], r[1] or "") in shared) for r in rows), key=str)


def sentence_runs(text, least):
    """All shortest runs of whole sentences with at least `least` words, each found on its own."""
    sentences = [s.split() for s in re.split(r"[.!?]+(?:[ \t-\r]+|\Z)|\n+", text.lower()) if s.split()]
    out = set()
    for i in range(len(sentences)):
        run = []
        for sentence in sentences[i:]:
            run += sentence
            if len(run) >= least:
                out.add(" ".join(run))
                break
    return out


@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_documents(spark, documents, odd_documents, kind):
    for df, least in ((documents, 8), (documents, 1), (odd_documents, 5)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sorted((tuple(r) for r in remove_repeated_units(df, kind, least).collect()), key=str)
        assert got == brute(rows, kind, least)


def test_earliest_stays_and_offsets_are_the_original_ones(spark):
    line = "a passage of more than eight words that is repeated"
    rows = [(3, f"x\n{line}\ny"), (1, f"{line.upper()} \nz"), (2, f"é\n{line}"), (None, line)]
    got = {r["doc_id"]: r for r in remove_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["removed"] == f"2:{2 + len(line)}" and got[3]["kept"] == "x\ny"
    assert got[None]["kept"] == "" and got[None]["n_units"] == 1


def test_passages_inside_lines(spark):
    """A passage of over 50 words within other lines marks its documents and nothing is removed; short common lines don't mark any."""
    part = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = f"{part('p', 20)}. {part('q', 15)}! {part('r', 17)}."
    rows = [(1, f"{part('a', 30)} {passage} {part('b', 30)}"), (2, f"{part('c', 9)} {passage} {part('d', 3)}\nshort line."), (3, f"{part('e', 80)}.\nshort line."), (4, passage[:60])]
    got = {r["doc_id"]: r for r in remove_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["has_passage"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 0, 1, 0]


def test_empty_table(spark, odd_documents):
    assert remove_repeated_units(odd_documents.limit(0)).count() == 0
