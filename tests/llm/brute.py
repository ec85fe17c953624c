"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").encode())


def repeated_passages(docs, window=35):
    places = {}
    split = {i: words(t) for i, t in docs.items()}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            places.setdefault(tuple(w[k : k + window]), []).append((i, k))
    gone = {i: set() for i in docs}
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                gone[i] |= set(range(k, k + window))
    return {i: (len(w), len(gone[i]), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[i])).hexdigest()) for i, w in split.items()}


def repeated_lines(docs, run=3):
    seen, gone, lines = set(), {}, {i: [x for x in (docs[i] or "").split("\n") if WORD.search(x.encode())] for i in sorted(docs)}
    for i, held in lines.items():
        gone[i] = set()
        for k in range(len(held) - run + 1):
            key = tuple(held[k : k + run])
            if key in seen:
                gone[i] |= set(range(k, k + run))
            seen.add(key)
    return {i: (len(held), len(gone[i]), [x for k, x in enumerate(held) if k not in gone[i]]) for i, held in lines.items()}


def fingerprint(text, n=4):
    upper = bytes(range(65, 91))
    w = WORD.findall((text or "").encode().translate(bytes.maketrans(upper, upper.lower())))
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(max(1, len(w) - n + 1))], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def components(nodes, linked):
    """Least reachable node of each; ``linked(a, b)`` tells neighbours."""
    nodes, found = sorted(nodes), {}
    for start in nodes:
        if start not in found:
            found[start], todo = start, [start]
            while todo:
                a = todo.pop()
                for b in nodes:
                    if b not in found and linked(a, b):
                        found[b] = start
                        todo.append(b)
    return found
