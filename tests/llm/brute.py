"""Plain single-machine versions that the operators are held against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def line_verdicts(rows, min_docs, share, min_left):
    """rows: (host, text), each a document; True where the row is depleted."""
    fold = lambda x: " ".join(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x)) for x in WORD.findall(x))
    holders, hosts = defaultdict(set), defaultdict(set)
    for i, (host, text) in enumerate(rows):
        hosts[host].add(i)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[host, fold(line)].add(i)
    out = []
    for host, text in rows:
        n = gone = 0
        for line in (text or "").split("\n"):
            k = len(WORD.findall(line))
            n += k
            if k and len(holders[host, fold(line)]) > max(min_docs, share * len(hosts[host])):
                gone += k
        out.append(gone > 0 and n - gone < n * min_left)
    return out


def removed_windows(texts, length=35):
    """Per text: words, removed words and digest of what is kept."""
    places = defaultdict(int)
    words = [WORD.findall(t or "") for t in texts]
    for w in words:
        for i in range(len(w) - length + 1):
            places[tuple(w[i : i + length])] += 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if places[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingles(text, n=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(rows, n=3, percent=90):
    """rows: (doc_id, text); doc_id -> (set size, smallest doc_id reachable)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(k)
    seen = set()
    for group in by.values():
        for x in range(len(group)):
            for y in range(x):
                seen.add((group[y], group[x]))
    for a, b in seen:
        (i, s), (j, t) = sets[a], sets[b]
        inter = len(s & t)
        if 100 * inter >= percent * (len(s) + len(t) - inter):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))


def propagated(units, target, shards, rounds, fill, least_room, luck):
    """units: (grp, chunk, bytes, shard); shard of each (grp, chunk) after label propagation under quotas."""
    at = {(g, c): (b, s) for g, c, b, s in units}
    for _ in range(rounds):
        load = [sum(b for b, s in at.values() if s == j) for j in range(shards)]
        room = [max(0, int(fill * target) - x) for x in load]
        if max(room) <= least_room * target:
            break
        here = Counter()
        for (g, _), (b, s) in at.items():
            here[g, s] += b
        aims = defaultdict(list)
        for (g, c), (b, s) in at.items():
            options = [(here[g, j], -j) for j in range(shards) if here[g, j] and room[j] > least_room * target]
            if options and max(options) > (here[g, s], -s):
                aims[-max(options)[1]].append((luck[g], g, c, b))
        moved = False
        for j, movers in aims.items():
            before = 0
            for _, g, c, b in sorted(movers):
                if before + b <= room[j]:
                    at[g, c] = (b, j)
                    moved = True
                before += b
        if not moved:
            break
    return {k: s for k, (_, s) in at.items()}


def ngram_buckets(text, bits):
    """Buckets of a text's 1- to 3-grams of lower-case letters with single gaps, hashed with plain integers."""
    full = (1 << 64) - 1

    def mix(x):
        x ^= x >> 31
        x = x * 0x7FB5D329728EA185 & full
        x ^= x >> 27
        x = x * 0x81DADEF4BC2DD44D & full
        return x ^ x >> 33

    kept = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    if not kept.strip():
        return []
    code = [ord(c) for c in " " + re.sub(" +", " ", kept).strip() + " "]
    out = []
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            value = n
            for x in code[i : i + n]:
                value = (value * 0x1FFFFF + x) & full
            out.append(mix(value) >> (64 - bits))
    return out


def naive_bayes(train, texts, bits):
    """train: (lang, text); (language, probability) of each text by multinomial naive Bayes with add-one smoothing."""
    counts = defaultdict(Counter)
    for lang, text in train:
        counts[lang].update(ngram_buckets(text, bits))
    out = []
    for text in texts:
        found = ngram_buckets(text, bits)
        if not found:
            out.append(("und", 0.0))
            continue
        score = {}
        for lang, c in counts.items():
            total = sum(c.values()) + (1 << bits)
            score[lang] = sum(math.log((c[b] + 1) / total) for b in found)
        best = min(score, key=lambda x: (-score[x], x))
        out.append((best, 1 / sum(math.exp(x - score[best]) for x in score.values())))
    return out
