"""Plain second implementations of the corpus operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bpe(text, path, pattern):
    import tiktoken

    if (path, pattern) not in bpe.made:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        bpe.made[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.made[path, pattern]
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


bpe.made = {}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(rows, bits=3):
    """{index: (fingerprint, component_id)} for (doc_id, text) rows."""
    fps = [fingerprint(t) for _, t in rows]
    kinds = sorted(set(fps))
    top = {f: f for f in kinds}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                top[root(a)] = root(b)
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for (d, _), f in zip(rows, fps)]


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window=13):
    out = []
    wins = defaultdict(set)
    for i, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOW))
        if w:
            for k in range(max(1, len(w) - window + 1)):
                wins[tuple(w[k : k + window])].add("" if i is None else str(i))
    lens = sorted({len(w) for w in wins})
    for d, t in rows:
        w = BENCH_WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[key]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(hit),
        "base_failed": len(words) < 50 or 100 * len(hit) > 50 * len(words),
    }


def lines(rows, ratio=0.01, least_pages=3, long_words=50, long_ratio=0.0002, long_least_pages=2):
    """[(doc_id, text, n_lines, n_dropped)] for (doc_id, host, text) rows."""
    pages, total = Counter(), Counter()
    for h, t in {(h or "", t) for _, h, t in rows if t is not None}:
        total[h] += 1
        for x in {x for x in t.split("\n") if x.strip(" ")}:
            pages[h, x] += 1

    def cut(h, x):
        long = len(re.findall(r"[^\x20\x09-\x0D]+", x)) > long_words
        return pages[h, x] >= (long_least_pages if long else least_pages) and pages[h, x] > (long_ratio if long else ratio) * total[h]

    out = []
    for d, h, t in rows:
        every = t.split("\n") if t is not None else []
        left = [x for x in every if not x.strip(" ") or not cut(h or "", x)]
        out.append((d, "\n".join(left) if t is not None else None, len(every), len(every) - len(left)))
    return out


# pseudonyms


def _mix(key, tweak, low, i, b):
    return int(hashlib.sha256(f"{key}|{tweak}|{low}|{i}|{b}".encode()).hexdigest()[:15], 16)


def feistel(x, high, low, tweak, key, rounds=10):
    a, b = divmod(x, low)
    for i in range(rounds):
        a, b = b, (a + _mix(key, tweak, low, i, b)) % (low if i % 2 else high)
    return a * low + b


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        v = int(c)
        t += v if k % 2 == 0 else v * 2 - (9 if v > 4 else 0)
    return t % 10


def pseudonymize(text, key, patterns):
    """(text, counts by kind)"""
    import datetime

    import regex

    one = {k: regex.compile(p) for k, p in patterns.items()}
    counts = Counter()

    def layout(m, digits):
        it = iter(digits)
        return "".join(next(it) if c in "0123456789" else c for c in m)

    def sub(found):
        m = found.group()
        kind = next(k for k, p in one.items() if p.fullmatch(m))
        d = re.sub(r"[^0-9]", "", m)
        new = m
        sha = lambda t: hashlib.sha256(f"{key}|{t}|{m}".encode()).hexdigest()
        if kind == "email":
            new = "u" + sha("email")[:16] + "@" + m.rpartition("@")[2]
        elif kind == "secret":
            new = (sha("secret1") + sha("secret2"))[: len(m)]
        elif kind == "ip":
            o = list(map(int, m.split(".")))
            if max(o) > 255:
                return m
            x = feistel(int.from_bytes(bytes(o), "big"), 65536, 65536, "ip", key)
            new = ".".join(map(str, x.to_bytes(4, "big")))
        elif kind == "date":
            y, mo, da = (m[:4], m[5:7], m[8:]) if m[4] == "-" else (m[6:], m[3:5], m[:2])
            try:
                x = (datetime.date(int(y), int(mo), int(da)) - datetime.date(1900, 1, 1)).days
            except ValueError:
                return m
            if not 0 <= x < 73049:
                return m
            while (x := feistel(x, 271, 271, "date", key)) >= 73049:
                pass
            t = (datetime.date(1900, 1, 1) + datetime.timedelta(x)).strftime("%Y%m%d")
            new = layout(m, t if m[4] == "-" else t[6:] + t[4:6] + t[:4])
        elif kind == "ssn":
            ok = lambda x: 1 <= x // 1000000 <= 899 and x // 1000000 != 666 and x // 10000 % 100 and x % 10000
            if not ok(x := int(d)):
                return m
            while not ok(x := feistel(x, 10**4, 10**5, "ssn", key)):
                pass
            new = layout(m, f"{x:09d}")
        elif kind == "phone":
            new = layout(m, d[:-10] + f"{feistel(int(d[-10:]), 10**5, 10**5, 'phone', key):010d}")
        else:
            if luhn(d):
                return m
            n = len(d) - 1
            e = f"{feistel(int(d[:-1]), 10 ** (n // 2), 10 ** (n - n // 2), 'card', key):0{n}d}"
            new = layout(m, e + next(c for c in "0123456789" if luhn(e + c) == 0))
        counts[kind] += 1
        return new

    out = regex.sub("|".join(patterns.values()), sub, text)
    return out, counts
