"""The operators once more, each as a plain loop over rows in memory."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, distance):
    """Smallest id that links lead to, by row."""
    prints, root = np.asarray(prints, np.uint64), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    lowest = {}
    for i, key in enumerate(ids):
        if key is not None:
            lowest[find(i)] = min(lowest.get(find(i), key), key)
    return [lowest.get(find(i)) for i in range(len(ids))]


def exact(rows):
    """By row ``(id, text)``: kept id, group size, digest."""
    groups = {}
    for key, text in rows:
        groups.setdefault(ascii_lower(text or ""), []).append(key)
    out = []
    for key, text in rows:
        group = groups[ascii_lower(text or "")]
        out.append((key, max((k for k in group if k is not None), default=None), len(group), sha(ascii_lower(text or ""))))
    return out


def gram_buckets(text):
    """How often each bucket is hit by the grams of one to three letters, one place after another; None without a letter."""
    letters = [32]
    for c in text + " ":
        code = ord(c.lower()[0]) if c.isalpha() else 32
        if code != 32 or letters[-1] != 32:
            letters.append(code)
    if len(letters) < 3:
        return None
    counts, wide = np.zeros(4096), 1 << 32
    one, two, three = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        pair = (a * two + b * three) % wide
        hashes = [pair, (pair * one + c * two + 1) % wide] + [b * one % wide] * (b != 32)
        for h in hashes:
            counts[(h ^ h >> 15) * three % wide >> 20] += 1
    return counts


def languages(learn, texts, sample, k=4, rounds=10):
    """Language and likeness of each text, learnt from the rows ``(text, lang)``."""
    known = [(t, lang, c) for t, lang in learn if lang is not None and (c := gram_buckets(t or "")) is not None]
    idf = np.log((1 + len(known)) / (1 + sum(c > 0 for _, _, c in known))) + 1

    def vector(counts):
        row = np.log1p(counts) * idf
        return row / np.linalg.norm(row)

    def place(text):
        seed = xxhash.xxh64_intdigest((11).to_bytes(4, "little"), 42)
        return (xxhash.xxh64_intdigest(text.encode(), seed) + (1 << 63)) % (1 << 64)

    centres = []
    for name in sorted({lang for _, lang, _ in known}):
        own = {place(t): vector(c) for t, lang, c in known if lang == name}
        rows = [own[p] for p in sorted(own)[:sample]]
        mean = sum(rows) / len(rows)
        found = [max(rows, key=lambda r: r @ mean)]
        while len(found) < min(k, len(rows)):
            found.append(min(rows, key=lambda r: max(r @ c for c in found)))
        for _ in range(rounds):
            members = [[] for _ in found]
            for r in rows:
                alike = [r @ c for c in found]
                members[alike.index(max(alike))].append(r)
            sums = [sum(m) if m else c for m, c in zip(members, found)]
            found = [x / np.linalg.norm(x) for x in sums]
        centres += [(name, c) for c in found]
    out = []
    for t in texts:
        counts = gram_buckets(t or "")
        best = max(((vector(counts) @ c, name) for name, c in centres), key=lambda x: x[0]) if counts is not None else (0.0, "und")
        out.append((best[1], min(1.0, max(0.0, best[0]))))
    return out


def versions(rows):
    """By id, for distinct ids: characters, digest of the edited text, both likenesses."""

    def lines(text):
        out = ""
        for i, word in enumerate(text.split(" ")):
            every = 2 if i < 8 else 4 if i < 64 else 32
            out += word + ("\n" if xxhash.xxh64_intdigest(word.encode(), 42) % every == 0 else " ")
        return {line for line in out.split("\n") if line.strip(" ")}

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    rows, out = sorted((key, text or "") for key, text in rows), {}
    for i, (key, text) in enumerate(rows):
        other, cut = rows[(i + 1) % len(rows)][1], len(text) // 4
        changed = text[: len(text) - cut] + other[:cut]
        out[key] = (len(text), sha(changed), likeness(lines(text), lines(changed)), likeness(lines(text), lines(other)))
    return out


def repeats(rows, window=13):
    """By row: words, words removed, digest of the rest."""
    first = {}
    split = [(key, WORD.findall(text or "")) for key, text in rows]
    for key, words in split:
        if key is not None:
            for i in range(len(words) - window + 1):
                seq = tuple(words[i : i + window])
                first[seq] = min(first.get(seq, key), key)
    out = []
    for key, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if key is not None and first[tuple(words[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((key, len(words), len(gone), sha(" ".join(kept))))
    return out


BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    ("hex", r"[0-9a-f]+", 0, 0, 16),
)


def base_secrets(text):
    found = []
    for order, (kind, pattern, flags, group, least) in enumerate(BASE):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def url_verdict(url, rules, globs):
    """Host, path, rule and verdict of a URL; rules ``(host, path, verdict)``, globs ``(pattern, verdict)``."""
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = ascii_lower(re.match(r"[^/?#]*", after)[0])
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        rule = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, rule[0] + rule[1], rule[2]
    for pattern, verdict in globs:
        expression = re.escape(pattern).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        if re.fullmatch(expression, host + path, re.S):
            return host, path, None, verdict
    return host, path, None, "allow"
