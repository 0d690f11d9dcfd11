"""Trees of all events against trees built node by node."""

import collections

from tidewell.plans import catalogue

DATA = "/root/testdata/sf0.001"


def built(nodes):
    """{seq: (depth, parent_seq)}, seqs in pre-order and in post-order of the tree that these insertions make."""
    value, kids, at = dict(nodes), {}, {}
    for seq, v in nodes:
        kids[seq] = [None, None]
        up, depth, now = None, 1, nodes[0][0]
        while now != seq:
            side = int(v >= value[now])
            up, depth = now, depth + 1
            if kids[now][side] is None:
                kids[now][side] = seq
            now = kids[now][side]
        at[seq] = (depth, up)
    pre, post = [], []

    def walk(seq):
        if seq is not None:
            pre.append(seq)
            walk(kids[seq][0])
            walk(kids[seq][1])
            post.append(seq)

    walk(nodes[0][0])
    return at, pre, post


def test_whole_trees(spark):
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/events.parquet").orderBy("event_id").collect():
        by[r.user_id].append((r.event_id, r.value))
    assert max(map(len, by.values())) > 30
    want = {u: built(nodes) for u, nodes in by.items()}
    got = {n: catalogue.QUERIES[f"bst_all_{n}"](spark, DATA).collect() for n in ("shape", "height", "width", "preorder", "postorder", "flatten")}
    assert {(r.tree, r.seq): (r.depth, r.parent_seq) for r in got["shape"]} == {(u, s): x for u, (at, _, _) in want.items() for s, x in at.items()}
    assert {(r.tree, r.size, r.height) for r in got["height"]} == {(u, len(at), max(d for d, _ in at.values())) for u, (at, _, _) in want.items()}
    assert {(r.tree, r.width) for r in got["width"]} == {(u, max(collections.Counter(d for d, _ in at.values()).values())) for u, (at, _, _) in want.items()}
    assert {(r.tree, r.seq): r.pre for r in got["preorder"]} == {(u, s): k for u, (_, pre, _) in want.items() for k, s in enumerate(pre)}
    assert {(r.tree, r.seq): r.post for r in got["postorder"]} == {(u, s): k for u, (_, _, post) in want.items() for k, s in enumerate(post)}
    assert {(r.tree, r.flat_pre, r.flat_post) for r in got["flatten"]} == {(u, ",".join(map(str, pre)), ",".join(map(str, post))) for u, (_, pre, post) in want.items()}
