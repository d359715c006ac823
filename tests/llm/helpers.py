"""Tables with what operators must survive, and brute-force versions to compare with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(20_000))
EDGE_TEXTS = [None, "", " \n\t ", "one", "a b c d", "Same text " * 6, "Same text " * 6, "é漢🎉 ½ x\x1cy\x85z", LONG, LONG + " end"]


def edge_documents(spark, extra=False):
    """NULLs in every column, empty and very long texts, repeated rows and ids."""
    rows = [(i, text, "en" if i % 2 else None, "s" if i % 3 else None, 1) for i, text in enumerate(EDGE_TEXTS)]
    rows += [rows[5], rows[5], (None, "no id at all", None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    if extra:  # names that the operators use themselves
        for name in ("size", "taken", "shard", "slot", "ids", "label", "n", "fp", "a.b", "key", "lang_pred", "kept"):
            frame = frame.withColumn(name, frame["doc_id"])
    return frame


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    found = words((text or "").translate(LOWER))
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def components(nodes, links):
    root = {node: node for node in nodes}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


def near_duplicates(docs, n=5, percent=75):
    """id -> (number of shingles, smallest id reachable), by counting what every pair shares."""
    sets = {i: shingles(text, n) for i, text in docs}
    holders = defaultdict(list)
    for i, found in sets.items():
        for shingle in found:
            holders[shingle].append(i)
    links = []
    for i, found in sets.items():
        shared = Counter(j for shingle in found for j in holders[shingle] if j > i)
        links += [(i, j) for j, both in shared.items() if 100 * both >= percent * (len(found) + len(sets[j]) - both)]
    root = components(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    found = words(text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = set()
    for i in range(len(found) - 7):
        if windows[tuple(found[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)
