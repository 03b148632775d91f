"""Plain versions of what the operators compute, for small inputs."""

import re
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def jaccard_components(rows):
    """Per row (shingles, links, least id reachable), comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)].append(doc_id)
    name = {root: min((i for i in ids if i is not None), default=None) for root, ids in least.items()}
    return [(rows[k][0], len(sets[k]), links[k], name[find(k)]) for k in range(len(rows))]
