"""Path enumeration on single graphs straight from the definitions, to hold the DataFrame operators against."""

from itertools import combinations


def norm_token(tok):
    kept = [c for c in tok.lower() if not c.isspace() and c not in "\"',"]
    return "".join([c for c in kept if c.isascii() and c.isalpha()] or kept)


def node_attr(nodes, n, name):
    """(type in parentheses, normalised token); the function's own name is <SELF>."""
    kind, tok = nodes[n]
    if tok is None:
        return kind, None
    if kind == name:
        kind = tok = "<SELF>"
    elif (kind, tok) == ("METHOD", name):
        tok = "<SELF>"
    wrapped = kind if kind[:1] + kind[-1:] == "()" else f"({kind})"
    return wrapped, norm_token(tok)


def ast(nodes, edges, root, name="f", max_length=8, max_width=2, up="^", down="_"):
    """Every pair of leaves with tokens, left before right, over their lowest common ancestor: at most ``max_length``
    nodes, and at most ``max_width`` between the ancestor's two children. edges: (src, dst) in child order."""
    above, place, kids = {}, {}, {}
    for s, d in edges:
        above[d], place[d] = s, len(kids.setdefault(s, []))
        kids[s].append(d)

    def to_root(n):
        chain = [n]
        while chain[-1] in above:
            chain.append(above[chain[-1]])
        return chain

    def label(n):
        return node_attr(nodes, n, name)[0]

    leaves = [c for c in map(to_root, nodes) if c[0] not in kids and c[-1] == root and node_attr(nodes, c[0], name)[1]]
    leaves.sort(key=lambda c: [place[n] for n in reversed(c[:-1])])
    out = []
    for a, b in combinations(leaves, 2):
        top = next(n for n in a if n in b)
        left, right = a[: a.index(top)], b[: b.index(top)]
        if place[right[-1]] - place[left[-1]] <= max_width and len(left) + 1 + len(right) <= max_length:
            path = up.join(map(label, [*left, top])) + down + down.join(map(label, reversed(right)))
            after = [*(place[n] for n in reversed(a[a.index(top):-1])), len(nodes)]  # a node comes after all below it
            out.append((after, place[left[-1]], place[right[-1]], (node_attr(nodes, a[0], name)[1], path, node_attr(nodes, b[0], name)[1])))
    return [row for *_, row in sorted(out, key=lambda x: x[:3])]


def flow(nodes, edges, entry, name="f", labelled=False, up="^", down="_"):
    """Simple paths from the entry that end in a node without successors, and those that close on a node of their own.
    Labelled: an edge goes on only if its label and the carried one contain each other; the narrower is carried.
    edges: (src, dst, label)."""
    start, out, todo = node_attr(nodes, entry, name)[1], [], [((entry,), "")]
    while todo:
        path, carried = todo.pop()
        types, end = [node_attr(nodes, n, name)[0] for n in path], node_attr(nodes, path[-1], name)[1]
        leaving = [e for e in edges if e[0] == path[-1]]
        if path[-1] in path[:-1]:
            out.append((start, down.join(types[:-1]) + up + types[-1], end))
        elif not leaving:
            out.append((start, down.join(types), end))
        else:
            for _, to, lab in reversed(leaving):
                if not (labelled and carried) or (lab is not None and (lab in carried or carried in lab)):
                    todo.append(((*path, to), lab if labelled and (not carried or lab in carried) else carried))
    return list(dict.fromkeys(out)) if labelled else out
