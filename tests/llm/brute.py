"""Plain versions of the numbered operators, for small fixtures."""

import hashlib
import re
from collections import defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text, k=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = defaultdict(int)
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                common[tuple(sorted((h[x], h[y])))] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring_kept(docs, width=50):
    """Words, and those that stay, per document."""
    first = {}
    split = {i: words(t) for i, t in docs}
    for i in sorted(split):
        w = split[i]
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        out[i] = w, [x for x, g in zip(w, gone) if not g]
    return out


def substring_texts(docs):
    return {i: " ".join(kept) for i, (_, kept) in substring_kept(docs).items()}


def substring_dedup(docs):
    return {i: (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (w, kept) in substring_kept(docs).items()}


def contained(docs, items, percent=75, k=5):
    out = {}
    for i, text in docs:
        w, hits = words(text, lower=True), []
        for item, t in items:
            iw = words(t, lower=True)
            if not iw:
                continue
            n = min(k, len(iw))
            want = {tuple(iw[j : j + n]) for j in range(len(iw) - n + 1)}
            have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if 100 * len(want & have) >= percent * len(want):
                hits.append(item)
        out[i] = ",".join(map(str, sorted(set(hits))))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
        len(w) < 20 or 100 * len(covered) > 30 * len(w),
    )


def license_base(text):
    """(n_words, n_base, first, last, base_labels)."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for label, phrase in (("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])):
        for i in range(len(w)):
            if w[i : i + len(phrase)] == phrase:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))
