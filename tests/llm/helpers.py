"""Plain versions of the contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width):
    words = SPACED.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def jaccard_components(rows, width, percent):
    """rows: list of (doc_id, text), distinct ids. doc_id to (size, component)."""
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination(text, items, window=13):
    """(n_words, n_hit, sorted item ids that occur)."""
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, content in items:
        own = ALNUM.findall(lower(content))
        size = min(window, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wanted:
                found.add(str(item))
                hit |= set(range(i, i + size))
    return len(words), len(hit), sorted(found)


def longest_match(text, items, window=13):
    """(words, word of the document, item, word of the item) of the longest match that begins with a window."""
    words, best = ALNUM.findall(lower(text)), None
    for item, content in items:
        own = ALNUM.findall(lower(content))
        size = min(window, len(own))
        for i in range(len(words)):
            for j in range(len(own) - size + 1) if own else ():
                if words[i : i + size] == own[j : j + size]:
                    n = size
                    while n >= window and i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                        n += 1
                    key = (-n, i, str(item), j)
                    best = min(best, key) if best else key
    return (-best[0], *best[1:]) if best else (0, None, None, None)


def quality_base(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated |= set(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            again += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": again,
        "n_repeat_words": len(repeated),
        "base_failed": len(words) < 20 or 100 * len(repeated) > 30 * len(words),
    }


def quality_verdict(text):
    """Whether a text passes the base and every rule of the cascade."""
    text, base = text or "", quality_base(text)
    words = SPACED.findall(text)
    n, lines = len(words), sum(bool(SPACED.search(x)) for x in text.split("\n"))
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    spelled, loud = sum(bool(re.search("[A-Za-z\x80-\U0010ffff]", w)) for w in words), sum(w.endswith("!") for w in words)
    return not (
        base["base_failed"]
        or 10 * base["n_symbols"] > 3 * n
        or not 2 * n <= base["word_chars"] <= 14 * n
        or 10 * base["n_dup_lines"] > 3 * lines
        or 10 * upper > 3 * letters
        or 10 * spelled < 7 * n
        or 10 * loud > 3 * n
    )


def crc_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def chat_digest(turns):
    """turns: (role, text) in order."""
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
