"""Plain readings of the operators, one document at a time, and tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def word_repeats(rows, window=50):
    """id -> (words, removed, kept text)"""
    first, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = bytearray(len(words))
        for j in range(len(words) - window + 1):
            if first.setdefault(tuple(words[j : j + window]), i) < i:
                gone[j : j + window] = b"\1" * window
        out[i] = len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)
    return out


def byte_repeats(rows, window=50):
    """id -> (bytes, removed, spans, digest of the rest)"""
    first, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - window + 1):
            if first.setdefault(data[j : j + window], i) < i:
                gone[j : j + window] = b"\1" * window
        spans = sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a)
        out[i] = len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest()
    return out


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_classes(rows, width, percent):
    """id -> (set size, smallest id reachable)"""
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for i in sorted(sets):
        done = set()
        for s in sets[i]:
            for j in by[s]:
                if j not in done:
                    done.add(j)
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * len(sets[i] | sets[j]):
                        a, b = find(i), find(j)
                        parent[max(a, b)] = min(a, b)
            by[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def thue_morse(n, one="ab", join=""):
    """Two texts of n places whose polynomials agree modulo 2**64 for every odd base, from 1024 places on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return join.join(one[b] for b in bits), join.join(one[1 - b] for b in bits)


def awkward_texts():
    """Nulls, empty and blank texts, one-word texts, a very long text, copies, a passage in many documents, and texts made to clash in polynomial hashes."""
    passage = " ".join(f"shared{i}" for i in range(60))
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one"), (7, long), (8, long), (9, "é ü\u00a0ß 漢字"), (None, passage), (None, None)]
    rows += [(100 + i, f"start{i} {passage} end{i} " + " ".join(f"own{i}y{k}" for k in range(40))) for i in range(30)]
    rows += [(200 + i, "\n".join(["the same line of a list, again and again, over and over it goes"] * 6)) for i in range(5)]
    base = [f"base{k}" for k in range(120)]
    rows += [(300 + i, " ".join(base[:i] + [f"changed{i}"] + base[i + 1 :])) for i in range(0, 40, 2)]
    rows += [(400 + i, "xyz " * (100 + i)) for i in range(4)]
    a, b = thue_morse(1024)
    rows += [(440, a), (441, b), (442, f"{a}\n{b}\n{a} {b}\n{b}"), (443, f"{b} {a} {a} {b} {a}")]
    rows += [(444 + i, t) for i, t in enumerate(thue_morse(1024, ("uu", "vv"), " "))]
    return rows


SCHEMA = "doc_id long, text string"


def awkward(spark, clash=()):
    """The awkward texts, with columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_texts(), SCHEMA).repartition(3)
    return df.withColumns({name: F.lit(None).cast("string") if k % 2 else F.lit(k) for k, name in enumerate(clash)})
