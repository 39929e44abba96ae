"""Similarity by its definition, for tests: sets of three neighbouring characters, earliest similar leader."""


def shingles(text):
    flat = " ".join((text or "").lower().split())
    return {"".join(three) for three in zip(flat, flat[1:], flat[2:])} or ({flat} if flat else set())


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def leaders_of(items, least=0.55):
    """cid -> leader for (cid, text) in row order: an item joins its earliest similar leader or leads itself."""
    sets, home = {cid: shingles(text) for cid, text in items}, {}
    for cid, _ in items:
        leading = (c for c in home if home[c] == c and jaccard(sets[c], sets[cid]) >= least)
        home[cid] = next(leading, cid)
    return home
