"""DuckDB SQL fragments used by the oracle queries (independent re-statements of the
column functions; DuckDB's regex has no look-around, so boundaries are inserted first)."""

from __future__ import annotations


def norm_token(x: str, default: str = "") -> str:
    cleaned = f"regexp_replace(regexp_replace(lower({x}), '\\s+', '', 'g'), '[\"'',]', '', 'g')"
    letters = f"regexp_replace({cleaned}, '[^A-Za-z]', '', 'g')"
    return f"(CASE WHEN {letters} <> '' THEN {letters} WHEN {cleaned} <> '' THEN {cleaned} ELSE '{default}' END)"


def subtokens(x: str) -> str:
    spaced = (
        f"regexp_replace(regexp_replace(regexp_replace(trim({x}), '([a-z])([A-Z])', '\\1 \\2', 'g'),"
        f" '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[0-9_]', ' ', 'g')"
    )
    return (
        f"list_filter(list_transform(regexp_split_to_array({spaced}, '\\s+'), lambda t: {norm_token('t')}), lambda t: t <> '')"
    )


def label(x: str, sep: str = "|") -> str:
    return f"array_to_string({subtokens(x)}, '{sep}')"


def paren(x: str) -> str:
    return f"(CASE WHEN starts_with({x}, '(') AND ends_with({x}, ')') THEN {x} ELSE '(' || {x} || ')' END)"


def java_hash(x: str) -> str:
    h = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
    return f"(CASE WHEN {x} = '' THEN 0::BIGINT ELSE ((({h}) + 2147483648) % 4294967296) - 2147483648 END)"


def v1_ctes() -> str:
    """V1 trees with normalised attributes: g(gid,name), o(order nodes), l(line nodes)."""
    return f"""
g AS (
  SELECT CAST(c_custkey AS VARCHAR) AS gid, c_mktsegment || '_' || n_name AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
o0 AS (
  SELECT g.gid, g.name, o_orderkey, 'o' || CAST(o_orderkey AS VARCHAR) AS node_id,
         row_number() OVER (PARTITION BY g.gid ORDER BY o_orderdate, o_orderkey) AS ord,
         CASE WHEN o_orderstatus = 'P' THEN g.name ELSE 'ORDER_' || o_orderstatus END AS typ,
         o_orderpriority AS tok
  FROM orders JOIN g ON CAST(o_custkey AS VARCHAR) = g.gid),
o AS (
  SELECT gid, o_orderkey, node_id, ord,
         CASE WHEN typ = name THEN '(<SELF>)' ELSE {paren('typ')} END AS ntype,
         CASE WHEN typ = name THEN 'self' ELSE {norm_token('tok')} END AS ntoken
  FROM o0),
l AS (
  SELECT o.gid, o.node_id AS parent, o.ord AS pord, o.ntype AS ptype,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_orderkey, l_partkey, l_suppkey,
            l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord,
         '(LINE_' || l_returnflag || l_linestatus || ')' AS ntype, p_name AS tok,
         {norm_token('p_name')} AS ntoken
  FROM lineitem JOIN o ON l_orderkey = o.o_orderkey JOIN part ON l_partkey = p_partkey)"""


def v1_pieces_ctes(max_tree_size: int | None = 200) -> str:
    """CTEs up to ``pieces`` (gid, top, top_key, top_type, o, len, up_path, down_path, tok, leaf_key)."""
    size_filter = ""
    where_keep = ""
    if max_tree_size is not None:
        size_filter = f"""
sz AS (
  SELECT g.gid, 1 + coalesce(oc.n, 0) + coalesce(lc.n, 0) AS n
  FROM g LEFT JOIN (SELECT gid, count(*) AS n FROM o GROUP BY gid) oc USING (gid)
         LEFT JOIN (SELECT gid, count(*) AS n FROM l GROUP BY gid) lc USING (gid)),
keep AS (SELECT gid FROM sz WHERE n > 0 AND n <= {max_tree_size}),"""
        where_keep = "WHERE gid IN (SELECT gid FROM keep)"
    return f"""{v1_ctes()},{size_filter}
pieces0 AS (
  SELECT gid, parent AS top, [0, pord, 2147483647] AS top_key, ptype AS top_type, ord AS o, 1 AS len,
         ntype AS up_path, ntype AS down_path, ntoken AS tok, [0, pord, ord] AS leaf_key FROM l
  UNION ALL
  SELECT gid, '1000101', [0, 2147483647], '(METHOD)', pord, 2,
         ntype || '^' || ptype, ptype || '_' || ntype, ntoken, [0, pord, ord] FROM l
  UNION ALL
  SELECT gid, '1000101', [0, 2147483647], '(METHOD)', ord, 1, ntype, ntype, ntoken, [0, ord]
  FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.parent = o.node_id AND l.gid = o.gid)),
pieces AS (SELECT * FROM pieces0 {where_keep})"""


def v1_ast_paths(max_length: int = 8, max_width: int = 2, max_tree_size: int | None = 200) -> str:
    """Contexts of V1 trees (three levels) by plain joins."""
    return f"""
WITH {v1_pieces_ctes(max_tree_size)},
pairs AS (
  SELECT a.gid, a.top_key, a.o AS o_l, b.o AS o_r, a.leaf_key AS key_l, b.leaf_key AS key_r,
         a.tok AS start_token, a.up_path || '^' || a.top_type || '_' || b.down_path AS path, b.tok AS end_token
  FROM pieces a JOIN pieces b ON a.gid = b.gid AND a.top = b.top
   AND b.o - a.o BETWEEN 1 AND {max_width} AND a.len + 1 + b.len <= {max_length})
SELECT gid AS graph_id, 'ast' AS kind,
       row_number() OVER (PARTITION BY gid ORDER BY top_key, o_l, o_r, key_l, key_r) - 1 AS seq,
       start_token, path, end_token
FROM pairs"""


def events_ctes(containment: bool = False) -> str:
    """V2/V3 inputs: consecutive steps per user (global position + 1)."""
    label = (
        "CASE k % 3 WHEN 0 THEN 'v' WHEN 1 THEN 'v1' ELSE 'v12' END" if containment else "'v' || CAST(k % 3 AS VARCHAR)"
    )
    return f"""
ev AS (
  SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS pos
  FROM events),
st AS (
  SELECT a.user_id, a.pos, a.event_type AS src, b.event_type AS dst, a.k
  FROM ev a JOIN ev b ON b.pos = a.pos + 1 AND a.user_id = b.user_id),
nn AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS gid, event_type AS node_id,
         '(' || upper(event_type) || ')' AS ntype, {norm_token('event_type')} AS ntoken
  FROM ev),
ed_cfg AS (SELECT CAST(user_id AS VARCHAR) AS gid, src, dst, min(pos) AS ord, NULL::VARCHAR AS label FROM st GROUP BY ALL),
ed_ddg AS (SELECT CAST(user_id AS VARCHAR) AS gid, src, dst, min(pos) AS ord, label
           FROM (SELECT *, {label} AS label FROM st) GROUP BY user_id, src, dst, label)"""


def v4_ctes() -> str:
    return f"""
nn AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS gid, '0' AS node_id, '(REGION)' AS ntype, {norm_token('r_name')} AS ntoken FROM region
  UNION ALL
  SELECT 'solo', '0', '(REGION)', {norm_token('r_name')} FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)
  UNION ALL
  SELECT CAST(r_regionkey AS VARCHAR), '1_' || CAST(n_nationkey AS VARCHAR), '(NATION)', {norm_token('n_name')}
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT CAST(r_regionkey AS VARCHAR), '2_' || CAST(c_custkey AS VARCHAR), '(' || c_mktsegment || ')', {norm_token('c_name')}
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ed_cdg AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS gid, '0' AS src, '1_' || CAST(n_nationkey AS VARCHAR) AS dst,
         CAST(n_nationkey AS BIGINT) AS ord, NULL::VARCHAR AS label
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT CAST(r_regionkey AS VARCHAR), '1_' || CAST(n_nationkey AS VARCHAR), '2_' || CAST(c_custkey AS VARCHAR),
         CAST(c_custkey AS BIGINT), NULL::VARCHAR
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def flow_walk(ctes: str, edges: str, kind: str, label_match: str = "contains") -> str:
    """Simple-path walk by WITH RECURSIVE over CTEs ``nn`` and ``{edges}``."""
    labelled = kind == "ddg"
    entry = "min(node_id)" if kind == "cdg" else "CASE WHEN bool_or(node_id = '1000101') THEN '1000101' ELSE min(node_id) END"
    node_filter = f"WHERE gid IN (SELECT gid FROM {edges})" if kind == "cdg" else ""
    if labelled:
        if label_match == "equals":
            compat = "(w.carried IS NULL OR w.carried = '' OR coalesce(w.carried = lk.label, false))"
            take = compat
        else:
            compat = ("(w.carried IS NULL OR w.carried = '' OR coalesce(contains(w.carried, lk.label), false)"
                      " OR coalesce(contains(lk.label, w.carried), false))")
            take = "(w.carried IS NULL OR w.carried = '' OR coalesce(contains(w.carried, lk.label), false))"
        new_carried = f"CASE WHEN {take} THEN lk.label ELSE w.carried END"
    else:
        compat = "true"
        new_carried = "w.carried"
    dedup = (
        "SELECT gid, start_token, path, end_token, min(ords) AS ords FROM res GROUP BY gid, start_token, path, end_token"
        if labelled
        else "SELECT * FROM res"
    )
    return f"""
WITH RECURSIVE {ctes},
nf AS (SELECT * FROM nn {node_filter}),
lk AS (SELECT e.gid, e.src, e.dst, e.ord, e.label, n.ntype AS dst_type, n.ntoken AS dst_token
       FROM {edges} e JOIN nf n ON n.gid = e.gid AND n.node_id = e.dst),
rt AS (SELECT gid, {entry} AS root FROM nf GROUP BY gid),
walk AS (
  SELECT n.gid, n.node_id AS node, [n.node_id] AS visited, [n.ntype] AS types, []::BIGINT[] AS ords,
         n.ntoken AS start_token, n.ntoken AS token, ''::VARCHAR AS carried, false AS closed, NULL::VARCHAR AS close_type
  FROM rt JOIN nf n ON n.gid = rt.gid AND n.node_id = rt.root
  UNION ALL
  SELECT w.gid, lk.dst,
         list_append(w.visited, lk.dst),
         CASE WHEN list_contains(w.visited, lk.dst) THEN w.types ELSE list_append(w.types, lk.dst_type) END,
         list_append(w.ords, CAST(lk.ord AS BIGINT)),
         w.start_token, lk.dst_token, {new_carried},
         list_contains(w.visited, lk.dst), lk.dst_type
  FROM walk w JOIN lk ON lk.gid = w.gid AND lk.src = w.node
  WHERE NOT w.closed AND {compat}),
res AS (
  SELECT gid, start_token, array_to_string(types, '_') || '^' || close_type AS path, token AS end_token, ords
  FROM walk WHERE closed
  UNION ALL
  SELECT gid, start_token, array_to_string(types, '_'), token, ords
  FROM walk w WHERE NOT closed AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.gid = w.gid AND lk.src = w.node)),
dd AS ({dedup})
SELECT gid AS graph_id, '{kind}' AS kind, row_number() OVER (PARTITION BY gid ORDER BY ords) - 1 AS seq,
       start_token, path, end_token
FROM dd"""


def v1_labels() -> str:
    name = "c_mktsegment || '_' || n_name"
    return (f"SELECT CAST(c_custkey AS VARCHAR) AS gid, {label(name)} AS label "
            "FROM customer JOIN nation ON c_nationkey = n_nationkey")


def path_dataset_ctes(k: int = 200, seed: str = "0") -> str:
    """CTE ``pd``: the flagship long table (graph_id, label, kind, seq, start_token, path, end_token)."""
    return f"""
pa AS ({v1_ast_paths()}),
pc AS ({flow_walk(events_ctes(), "ed_cfg", "cfg")}),
pg AS ({flow_walk(v4_ctes(), "ed_cdg", "cdg")}),
pe AS ({flow_walk(events_ctes(), "ed_ddg", "ddg")}),
lab AS ({v1_labels()}),
funcs AS (SELECT gid AS graph_id, label FROM lab WHERE label <> '' AND gid IN (SELECT graph_id FROM pa)),
allc AS (SELECT * FROM pa UNION ALL SELECT * FROM pc UNION ALL SELECT * FROM pg UNION ALL SELECT * FROM pe),
js AS (SELECT allc.*, funcs.label,
              row_number() OVER (PARTITION BY allc.graph_id, kind
                                 ORDER BY md5(concat_ws('|', '{seed}', allc.graph_id, kind, CAST(seq AS VARCHAR))), seq) AS rk
       FROM allc JOIN funcs ON allc.graph_id = funcs.graph_id),
pd AS (SELECT graph_id, label, kind, seq, start_token, path, end_token FROM js WHERE rk <= {k})"""


def max_case(max_paths: dict) -> str:
    return ("CASE kind " + " ".join(f"WHEN '{k}' THEN {int(v)}" for k, v in max_paths.items()) + " ELSE 0 END")


def pad(x: str, n: int) -> str:
    return f"list_concat(coalesce({x}, []::VARCHAR[]), list_transform(range(greatest({n} - len(coalesce({x}, []::VARCHAR[])), 0)), lambda i: ''))"


def model_rows_ctes(max_paths: dict, exclude: tuple = ()) -> str:
    """CTEs ``lf`` (label-filtered), ``vc`` (valid), ``hk`` (capped), ``rows`` (slot arrays)."""
    ex = "".join(f" AND label <> '{e}'" for e in exclude if e)
    valid = " AND ".join(f"{c} IS NOT NULL AND trim({c}) <> ''" for c in ("start_token", "path", "end_token"))
    pads = ", ".join(f"{pad('p_' + k, int(max_paths.get(k, 0)))} AS {k}" for k in ("ast", "cfg", "cdg", "ddg"))
    aggs = ", ".join(f"list(slot ORDER BY seq) FILTER (WHERE kind = '{k}') AS p_{k}" for k in ("ast", "cfg", "cdg", "ddg"))
    return f"""
lf AS (SELECT * FROM pd WHERE label IS NOT NULL AND trim(label) <> ''{ex}),
vc AS (SELECT * FROM lf WHERE {valid}),
hk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, kind ORDER BY seq) AS rk FROM vc)
       WHERE rk <= {max_case(max_paths)}),
sl AS (SELECT graph_id, kind, seq, start_token || ',' || CAST({java_hash('path')} AS VARCHAR) || ',' || end_token AS slot FROM hk),
per AS (SELECT graph_id, {aggs} FROM sl GROUP BY graph_id),
ex AS (SELECT DISTINCT graph_id, label FROM lf),
rows AS (SELECT ex.graph_id, ex.label, {pads} FROM ex LEFT JOIN per USING (graph_id))"""


def split_ctes(seed: str = "0") -> str:
    """CTEs ``sh`` (shuffled position) and ``sp`` (split)."""
    b1 = "round_even(n::DOUBLE * 0.89::DOUBLE, 0)"
    b2 = f"{b1} + round_even(n::DOUBLE * 0.035::DOUBLE, 0)"
    b3 = f"{b2} + round_even(n::DOUBLE * 0.075::DOUBLE, 0)"
    return f"""
sh AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', graph_id)), graph_id) - 1 AS pos FROM rows),
cnt AS (SELECT count(*) AS n FROM rows),
sp AS (SELECT sh.*, CASE WHEN pos < {b1} THEN 'train' WHEN pos < {b2} THEN 'val' WHEN pos < {b3} THEN 'test' END AS split
       FROM sh, cnt)"""


def kept_cte(include: tuple) -> str:
    inc = [k for k in ("ast", "cfg", "cdg", "ddg") if k in include]
    cond = " AND ".join(f"len({k}) > 0 AND {k}[1] <> ''" for k in inc)
    cat = inc[0]
    for k in inc[1:]:
        cat = f"list_concat({cat}, {k})"
    return f"""
kept AS (SELECT *, label || ' ' || array_to_string({cat}, ' ') AS line FROM sp WHERE split IS NOT NULL AND {cond})"""


def train_slots_cte(include: tuple) -> str:
    inc = [k for k in ("ast", "cfg", "cdg", "ddg") if k in include]
    cat = inc[0]
    for k in inc[1:]:
        cat = f"list_concat({cat}, {k})"
    return f"""
tr AS (SELECT * FROM kept WHERE split = 'train'),
ts AS (SELECT graph_id, label, string_split(s, ',') AS f FROM (SELECT graph_id, label, unnest({cat}) AS s FROM tr) WHERE s <> '')"""


def v9_ctes() -> str:
    """V9 code property graph pieces: cn (order calls), ll (argument lines)."""
    return f"""{v1_ctes()},
oo AS (SELECT o0.gid, o0.node_id AS onode, o0.ord AS k, orders.o_orderstatus AS st, o0.tok AS pr
       FROM o0 JOIN orders ON orders.o_orderkey = o0.o_orderkey),
cn AS (SELECT *, CASE WHEN pr = '5-LOW' AND k % 3 = 0 THEN 'copy_from_user' WHEN pr = '1-URGENT' AND k % 5 = 0 THEN '__get_user' ELSE CASE pr WHEN '1-URGENT' THEN 'malloc' WHEN '2-HIGH' THEN '<operator>.subtraction'
                         WHEN '3-MEDIUM' THEN '<operator>.addition' WHEN '4-NOT SPECIFIED' THEN '<operator>.indirectFieldAccess'
                         WHEN '5-LOW' THEN 'free' ELSE 'unknown' END END AS cname,
                 CASE st WHEN 'F' THEN 'int' WHEN 'O' THEN 'char*' WHEN 'P' THEN 'char[8]' ELSE 'ANY' END AS ttype FROM oo),
ll AS (SELECT gid, parent AS onode, parent || '_' || CAST(ord AS VARCHAR) AS lnode, ord AS arg,
              substr(ntype, 7, 1) AS flag, substr(ntype, 8, 1) AS status, tok AS code FROM l)"""
