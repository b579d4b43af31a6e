"""The conversation trie by plain dictionaries."""

import hashlib
import re
import zlib


def rebuilt(rows):
    """conv_id -> turns from (conv_id, turn, role, text) rows, first turns taken from the base conversation."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(conv - conv % 20, [])[:h] + turns[h:]
    return out


def trie(walks):
    """(conv_id, depth) -> (parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    members = {}
    for conv, turns in walks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)

    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[c] for c in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = sum(saved[c] for c in below) + (len(members[k]) - 1) * words
    ends = {}
    for conv in sorted(walks):
        ends.setdefault(tuple(walks[conv]), []).append(str(conv))
    digest = lambda k: hashlib.sha256(",".join(ends.get(k, [])).encode()).hexdigest()
    return {
        (min(m), len(k)): (min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], digest(k))
        for k, m in members.items()
    }
