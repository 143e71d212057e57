"""The scan against every line and sentence of every document of the tables held against every template, without hints and compression."""

import re
from collections import Counter
from difflib import SequenceMatcher

from riskloom.llm.licenses import LEAST_COMMON, SENTENCE, TEMPLATES, WORD, scan

TELLING = {"cc", "by", "by-nc", "by-sa", "mit", "gnu", "lesser", "apache", "mozilla", "noncommercial", "sharealike"}


def exhaustive(text):
    """The licences of all pieces, a line or one to three sentences of it, that hold enough of a template's words in order, and each word that tells it."""
    wanted = [(name, WORD.findall(t.lower())) for name, ts in TEMPLATES.items() for t in ts]
    out = set()
    for line in text.split("\n"):
        cuts = [0, *(m.end() for m in SENTENCE.finditer(line)), len(line)]
        pieces = {line} | {line[cuts[i] : cuts[j]] for i in range(len(cuts) - 1) for j in range(i + 1, min(i + 4, len(cuts)))}
        best = []
        for p in pieces:
            words = [w.lower() for w in WORD.findall(p)]
            there = Counter(words)
            for name, t in wanted:
                if sum((Counter(t) & there).values()) < LEAST_COMMON * len(t):
                    continue
                common = sum(m.size for m in SequenceMatcher(None, words, t, autojunk=False).get_matching_blocks()) / len(t)
                telling = {w for w in t if re.search(r"\d", w) or w in TELLING} - set(words)
                if common >= LEAST_COMMON and not telling:
                    best.append((common, len(t), name))
        if best:
            out.add(max(best)[2])
    return out


def test_no_document_with_a_notice_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {(r.doc_id, name) for r in docs.collect() for name in exhaustive(r.text or "")}
    got = {(r.doc_id, r.license) for r in scan(docs).collect()}
    assert want and len({d for d, _ in want} - {d for d, _ in got}) == 0
    assert len(want & got) >= 0.98 * len(want)
