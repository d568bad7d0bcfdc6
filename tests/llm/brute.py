"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def repetition(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_chars_5."""
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    before, five = set(), set()
    for i in range(len(words) - 4):
        gram = tuple(words[i : i + 5])
        if gram in before:
            five.update(range(i, i + 5))
        before.add(gram)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(cover), sum(len(words[i]) for i in five)


def line_dedup(docs: list[tuple[int | None, str | None]], min_chars: int = 40, min_docs: int = 5) -> list[tuple[int, int, str]]:
    """n_lines, n_dropped, kept per row."""
    key = lambda line: line.translate(UPPER).strip(" \t\n\x0b\x0c\r")
    where = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(doc_id)
    last = {}
    for k, ids in where.items():
        known = ids - {None}
        if len(known) >= min_docs:
            last[k] = max(known)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc_id]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(UPPER))


def contamination(text: str | None, items: list[tuple[object, str | None]]) -> tuple[int, int, list[str]]:
    words, hit, found = terms(text), set(), set()
    for item_id, item in items:
        asked = terms(item)
        n = min(13, len(asked))
        windows = {tuple(asked[i : i + n]) for i in range(len(asked) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def groups(values: list[int], max_bits: int = 4) -> list[int]:
    """Index of the first member of each value's component."""
    parent, a = list(range(len(values))), np.array(values, np.uint64)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= max_bits) + i + 1:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def repeated_words(docs: list[tuple[int, str | None]], size: int) -> set[tuple[int, int]]:
    """``(doc_id, word)`` of all words in a run of ``size`` words that another document has too."""
    where = defaultdict(set)
    words = {i: (t or "").encode().split() for i, t in docs}
    for i, w in words.items():
        for j in range(len(w) - size + 1):
            where[tuple(w[j : j + size])].add(i)
    return {(i, k) for i, w in words.items() for j in range(len(w) - size + 1) if len(where[tuple(w[j : j + size])]) > 1 for k in range(j, j + size)}


def dice_matches(text: str | None, templates: list[tuple[str, list[str]]], limit: float = 0.8) -> set[tuple[str, str, float]]:
    if text is None:
        return set()
    out = set()
    for block in {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text}:
        words = re.sub("[^a-z0-9]+", " ", block.translate(UPPER)).split()
        grams = {f"{a} {b}" for a, b in zip(words, words[1:])}
        scored = [(-2 * len(grams & set(t)) / (len(grams) + len(t)), name) for name, t in templates if grams]
        if scored and -min(scored)[0] >= limit:
            out.add((block, min(scored)[1], round(-min(scored)[0], 9)))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def mix_targets(sizes, weights, most=3):
    """Targets by the words of the contract: share, stop at the bound, share the excess again."""
    target = [0.0] * len(sizes)
    rest = [i for i, s in enumerate(sizes) if s]
    excess = float(sum(sizes))
    while excess > 1e-9 and rest:
        total = sum(weights[i] for i in rest)
        for i in rest:
            target[i] += excess * weights[i] / total
        excess = sum(max(0.0, target[i] - most * sizes[i]) for i in rest)
        for i in rest:
            target[i] = min(target[i], most * sizes[i])
        rest = [i for i in rest if target[i] < most * sizes[i]]
    return target


def repair(rows):
    """Result of one conversation's rows ``(turn, role, text)`` in order, by a forward search over states."""
    blanks = re.compile("[^\x20\x09-\x0d]")
    seen, faults = set(), []
    for _, role, text in rows:
        found = blanks.findall(text)
        if not found:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    prefix = re.compile("(s?(ua)*u?)?")
    # best[string's shape] = (cost, audit, repaired lines); the shape is all that later rows depend on
    shape = lambda s: "" if not s else "s" if s == "s" else s[-1]
    best = {"": (0, "", ())}

    def inserted(table):
        todo = dict(table)
        for _ in range(3):
            for k, (cost, audit, lines) in list(todo.items()):
                for role in ("user", "assistant"):
                    if prefix.fullmatch(full[k] + role[0]):
                        new = shape(full[k] + role[0])
                        option = (cost + 2, audit + "I", (*lines, f"{role}:"))
                        if new not in todo or option[:2] < todo[new][:2]:
                            todo[new] = option
        return todo

    full = {"": "", "s": "s", "u": "u", "a": "ua"}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for k, (cost, audit, lines) in inserted(best).items():
            options = [(k, cost + 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for edit, name, extra in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if prefix.fullmatch(full[k] + name[:1]):
                        options.append((shape(full[k] + name[:1]), cost + extra + more, edit, (*lines, f"{name}:{text}")))
            for to, total, edit, made in options:
                option = (total, audit + edit, made)
                if to not in new or option[:2] < new[to][:2]:
                    new[to] = option
        best = new
    ends = {k: v for k, v in inserted(best).items() if k in ("", "a")}
    cost, audit, lines = min(ends.values(), key=lambda x: x[:2])
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def conversations(rows):
    """``conv_id -> result`` of rows ``(conv_id, turn, role, text)`` after the fixed damage."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: repair(sorted(kept, key=order)) for conv, kept in found.items()}


def ranked(items, docs, k=20):
    """``(item, rank, doc_id, score)`` of every item against every document, straight from the formula."""
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [w.translate(low) for w in term.findall(t or "")]
    bags = [(doc, Counter(split(t)), len(split(t))) for doc, t in docs]
    bags = [b for b in bags if b[2]]
    n_docs, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        asked = Counter(split(text))
        scores = []
        for doc, bag, n in bags:
            m = 75 + 25 * n * n_docs // total
            score = sum(
                c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t, c in asked.items()
                if t in bag
            )
            if score > 0:
                scores.append((-score, doc))
        out += [(item, i + 1, doc, -score) for i, (score, doc) in enumerate(sorted(scores)[:k])]
    return out
