"""Plain Python versions of what the queries return, from (doc_id, text) rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokens(rows, tok):
    out = {}
    for key, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        out[key] = (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    return out


def substrings(rows, n=20):
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - n + 1):
            block = tuple(words[k : k + n])
            if block in seen:
                gone[k : k + n] = [True] * n
            seen.add(block)
        out[key] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def edits(rows):
    rows = sorted((k, t or "") for k, t in rows)
    out = {}
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        out[key] = (len(text), sha(text[: len(text) - n] + following[:n]))
    return out


def planes(rows, tok, end=2):
    out, start = {}, 0
    for key, text in sorted((k, t or "") for k, t in rows):
        ids = tok.encode(text, add_special_tokens=False).ids + [end]
        out[key] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def quality(rows):
    out = {}
    for key, text in rows:
        words = WORD.findall(text or "")
        seen, dups = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        blocks = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = len({j for k in range(len(words) - 7) if blocks[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)})
        out[key] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, repeated, len(words) < 20 or 100 * repeated > 30 * len(words))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private(text):
    out = []
    for kind, rule in BASE.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def near(rows):
    sets = {}
    for key, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets[key] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    at = defaultdict(list)
    for key, s in sets.items():
        for x in s:
            at[x].append(key)
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for key, s in sets.items():
        for other, both in Counter(o for x in s for o in at[x] if o > key).items():
            if 100 * both >= 80 * (len(s) + len(sets[other]) - both):
                a, b = find(key), find(other)
                top[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}
