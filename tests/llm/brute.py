"""Plain versions of the operators, for small tables."""

import base64
import re

import public_tokenizers
import tiktoken

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    words = WORD.findall(ascii_lower(text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def jaccard_components(rows, percent=80):
    """key -> smallest key reachable, over all pairs that share a shingle."""
    sets = {k: shingle_set(t) for k, t in rows.items()}
    holders = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    parent = {k: k for k in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    seen = set()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    shared = len(sets[a] & sets[b])
                    if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                        low, high = sorted((root(a), root(b)))
                        parent[high] = low
    return {k: root(k) for k in rows}


def tiktoken_encoding(name="byte_bpe_multi_50k.tiktoken"):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
