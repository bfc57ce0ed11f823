"""Named queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import scalars as S
from .operators import candidates, dedup, diff, directories, groups, stats
from .options import Options
from .plans import reports
from .plans.analysis import Analysis
from .sources import archive, cache, corpora, imagebuild, imagefs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- SQL parts

_ORDINAL = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_shipdate, l_linenumber, l_returnflag, l_linestatus)"
_ENTRIES = {
    "docs": "SELECT '/docs/'||source||'/'||lang||'/'||doc_id AS path, text AS content, 0::BIGINT AS ctime, doc_id+1 AS phys, (1+strlen(text)//4096)::INTEGER AS n_extents FROM documents",
    "orders": f"SELECT '/orders/'||l_orderkey||'/'||{_ORDINAL} AS path, l_returnflag||'|'||l_linestatus AS content, (epoch_us(l_shipdate)//1000000)::BIGINT AS ctime, l_partkey AS phys, l_suppkey::INTEGER AS n_extents FROM lineitem",
    "events": "SELECT '/events/'||user_id||'/'||strftime(ts,'%Y-%m-%d')||'/'||row_number() OVER (PARTITION BY user_id, strftime(ts,'%Y-%m-%d') ORDER BY ts, event_id) AS path, event_type AS content, (epoch_us(ts)//1000000)::BIGINT AS ctime, event_id+1 AS phys, 1::INTEGER AS n_extents FROM events",
    "conv": "SELECT '/conv/'||conv_id||'/'||turn AS path, text AS content, 0::BIGINT AS ctime, NULL::BIGINT AS phys, NULL::INTEGER AS n_extents FROM conversations",
    "pages": "SELECT '/pages/'||regexp_replace(regexp_extract(url,'://([^?#]*)',1),'/+$','') AS path, html AS content, 0::BIGINT AS ctime, NULL::BIGINT AS phys, NULL::INTEGER AS n_extents FROM pages",
    "cust": "SELECT '/cust/'||r_name||'/'||n_name||'/'||c_custkey AS path, c_mktsegment AS content, 0::BIGINT AS ctime, NULL::BIGINT AS phys, NULL::INTEGER AS n_extents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "flags": "SELECT '/flags/'||l_returnflag||'/'||l_orderkey||'/'||l_linenumber AS path, min(l_linestatus) AS content, 0::BIGINT AS ctime, NULL::BIGINT AS phys, NULL::INTEGER AS n_extents FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber",
}
_CORPORA = {"docs": corpora.docs, "orders": corpora.orders, "events": corpora.events, "conv": corpora.conversations, "pages": corpora.pages,
    "cust": corpora.customers, "flags": corpora.flags}
_DEPTH = {"docs": 4, "orders": 3, "events": 4, "conv": 3, "flags": 4}
_ANCESTORS = "list_transform(range(1, len(string_split(path,'/'))), lambda i: array_to_string(string_split(path,'/')[1:i],'/'))"


def _base(corpus: str) -> str:
    """entries and files (hashed where the size is shared)."""
    return f"""raw AS ({_ENTRIES[corpus]}),
entries AS (SELECT path, regexp_replace(path,'/[^/]*$','') AS parent_path, string_split(path,'/')[-1] AS name, strlen(content)::BIGINT AS file_size, ctime, phys, n_extents, content FROM raw),
shared AS (SELECT file_size FROM entries GROUP BY file_size HAVING count(*) > 1),
files AS (SELECT path, parent_path, name, file_size, ctime, phys, n_extents, CASE WHEN file_size IN (SELECT file_size FROM shared) THEN sha256(content) END AS file_hash FROM entries)"""


def _tree(corpus: str) -> str:
    """dirs by levels, members."""
    pieces = [f"sum(('0x'||substr(sha256(name||h),{1 + directories.DIGITS * k},{directories.DIGITS}))::BIGINT)" for k in range(directories.PIECES)]
    digest = f"sha256(concat_ws('|',count(*),{','.join(pieces)}))"
    parts, below = [], "SELECT parent_path, name, file_hash AS h, file_size AS size FROM files"
    for d in range(_DEPTH[corpus] - 1, -1, -1):
        parts.append(
            f"d{d} AS (SELECT parent_path AS path, CASE WHEN count(*)=count(h) THEN sum(size)::BIGINT END AS dir_size, CASE WHEN count(*)=count(h) THEN {digest} END AS dir_hash FROM ({below}) GROUP BY parent_path)")
        below = f"SELECT regexp_replace(path,'/[^/]*$','') AS parent_path, string_split(path,'/')[-1] AS name, dir_hash AS h, dir_size AS size FROM d{d}"
    union = " UNION ALL ".join(f"SELECT * FROM d{d}" for d in range(_DEPTH[corpus]))
    parts.append(f"dirs AS ({union})")
    parts.append("members AS (SELECT file_hash AS hash,'F' AS typ,2 AS typ_order,path,file_size AS size FROM files WHERE file_hash IS NOT NULL UNION ALL SELECT dir_hash,'D',1,path,dir_size FROM dirs WHERE dir_hash IS NOT NULL)")
    return ",\n".join(parts)


_SHADOW = f"""counted AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM members),
dups AS (SELECT DISTINCT path FROM counted WHERE n > 1),
places AS (SELECT path, unnest({_ANCESTORS}) AS above FROM (SELECT DISTINCT path FROM members)),
below AS (SELECT DISTINCT p.path FROM places p JOIN dups d ON p.above = d.path),
flagged AS (SELECT c.*, b.path IS NOT NULL AS shadowed FROM counted c LEFT JOIN below b ON c.path = b.path)"""

_VISIBLE = """sums AS (SELECT *, count(*) FILTER (WHERE NOT shadowed) OVER (PARTITION BY hash) AS ns FROM flagged WHERE n > 1),
ruled AS (SELECT *, ({hide}) AS hide FROM sums),
shown AS (SELECT * FROM ruled WHERE (NOT hide OR ns > 1) AND (NOT hide OR NOT shadowed))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _analysis(spark: SparkSession, sf_dir: str, corpus: str) -> Analysis:
    return Analysis(_CORPORA[corpus](spark, sf_dir), max_depth=_DEPTH[corpus])


# ---------------------------------------------------------------- scans and candidates


def _register_scans() -> None:
    columns = ["path", "parent_path", "name", "file_size", "ctime", "phys", "n_extents"]
    for corpus in ("docs", "orders", "events", "pages", "conv", "cust"):
        query(f"scan_{corpus}_entries", f"WITH {_base(corpus)} SELECT {', '.join(columns)} FROM entries")(lambda spark, sf_dir,
            c=corpus: _CORPORA[c](spark, sf_dir).select(*columns))


_register_scans()

_CANDIDATES = "(file_size IN (SELECT file_size FROM shared){more})"


@query("scan_stats_docs",
    f"WITH {_base('docs')} SELECT count(*) AS found_files, sum(file_size)::BIGINT AS found_bytes, count(*) FILTER (WHERE {_CANDIDATES.format(more='')}) AS relevant_files, coalesce(sum(file_size) FILTER (WHERE {_CANDIDATES.format(more='')}),0)::BIGINT AS relevant_bytes FROM entries")
def scan_stats_docs(spark, sf_dir):
    return stats.scan_stats(_analysis(spark, sf_dir, "docs").candidates)


@query("size_groups_docs", f"WITH {_base('docs')} SELECT file_size, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM entries GROUP BY file_size")
def size_groups_docs(spark, sf_dir):
    return candidates.size_groups(corpora.docs(spark, sf_dir))


@query("size_multiplicity_events",
    f"WITH {_base('events')} SELECT file_size, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM entries GROUP BY file_size HAVING count(*) > 1")
def size_multiplicity_events(spark, sf_dir):
    return candidates.size_groups(corpora.events(spark, sf_dir)).where("n > 1")


@query("read_candidates_docs", f"WITH {_base('docs')} SELECT path, file_size, {_CANDIDATES.format(more='')} AS candidate FROM entries")
def read_candidates_docs(spark, sf_dir):
    return _analysis(spark, sf_dir, "docs").candidates.select("path", "file_size", "candidate")


@query("read_candidates_bounds_docs",
    f"WITH {_base('docs')} SELECT path, file_size, {_CANDIDATES.format(more=' AND file_size BETWEEN 500 AND 5000')} AS candidate FROM entries")
def read_candidates_bounds_docs(spark, sf_dir):
    return candidates.read_candidates(corpora.docs(spark, sf_dir), Options(min_size=500, max_size=5000)).select("path", "file_size", "candidate")


@query("content_hash_docs", f"WITH {_base('docs')} SELECT path, file_size, file_hash FROM files")
def content_hash_docs(spark, sf_dir):
    return _analysis(spark, sf_dir, "docs").files.select("path", "file_size", "file_hash")


@query("hash_groups_docs",
    f"WITH {_base('docs')} SELECT file_hash AS hash, count(*) AS n, min(file_size) AS size FROM files WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1")
def hash_groups_docs(spark, sf_dir):
    return groups.duplicate_hashes(groups.members(_analysis(spark, sf_dir, "docs").files))


@query("hash_group_counts_orders", f"WITH {_base('orders')}, {_tree('orders')} SELECT hash, count(*) AS n, min(size) AS size FROM members GROUP BY hash")
def hash_group_counts_orders(spark, sf_dir):
    return groups.hash_counts(_analysis(spark, sf_dir, "orders").members)


@query(
    "post_hash_closure_docs",
    f"WITH {_base('docs')}, inner_sizes AS (SELECT strlen(text)::BIGINT AS file_size FROM benchmark), allsizes AS (SELECT file_size FROM entries UNION ALL SELECT file_size FROM inner_sizes), twice AS (SELECT file_size FROM allsizes GROUP BY 1 HAVING count(*)>1) "
    "SELECT path, file_size, file_size IN (SELECT file_size FROM twice) AS candidate FROM entries",
)
def post_hash_closure_docs(spark, sf_dir):
    inner = corpora.table(spark, sf_dir, "benchmark").select(F.octet_length("text").cast("long").alias("file_size"))
    return candidates.read_candidates(corpora.docs(spark, sf_dir), members=inner).select("path", "file_size", "candidate")


# ---------------------------------------------------------------- directories


def _register_directories() -> None:
    for corpus in ("events", "docs"):
        sql = f"WITH {_base(corpus)} SELECT a AS path, sum(file_size)::BIGINT AS dir_size, count(*) AS n_files FROM (SELECT file_size, unnest({_ANCESTORS}) AS a FROM entries) GROUP BY a"
        query(f"dir_sizes_{corpus}", sql)(lambda spark, sf_dir, c=corpus: directories.directory_sizes(_CORPORA[c](spark, sf_dir)))
    for corpus in ("orders", "events"):
        query(f"dir_hash_{corpus}", f"WITH {_base(corpus)}, {_tree(corpus)} SELECT path, dir_size, dir_hash FROM dirs")(lambda spark, sf_dir,
            c=corpus: _analysis(spark, sf_dir, c).dirs.select("path", "dir_size", "dir_hash"))

        def dup_dirs(spark, sf_dir, c=corpus):
            dirs = _analysis(spark, sf_dir, c).dirs.where("dir_hash is not null").select(F.col("dir_hash").alias("hash"), "path",
                F.col("dir_size").alias("size"))
            return groups.duplicates(dirs).select("hash", "path", "size", "n")

        query(f"dup_dirs_{corpus}",
            f"WITH {_base(corpus)}, {_tree(corpus)} SELECT dir_hash AS hash, path, dir_size AS size, n FROM (SELECT *, count(*) OVER (PARTITION BY dir_hash) AS n FROM dirs WHERE dir_hash IS NOT NULL) WHERE n > 1")(dup_dirs)

        def signatures(spark, sf_dir, c=corpus):
            signed = directories.flat_signatures(_analysis(spark, sf_dir, c).files)
            sizes = signed.groupBy("signature").agg(F.count("*").alias("copies"))
            return signed.join(sizes, "signature").select("path", "dir_size", "copies")

        query(f"flat_signature_{corpus}",
            f"WITH {_base(corpus)}, {_tree(corpus)} SELECT path, dir_size, count(*) OVER (PARTITION BY dir_hash) AS copies FROM dirs WHERE dir_hash IS NOT NULL")(signatures)
        query(f"shadow_flags_{corpus}", f"WITH {_base(corpus)}, {_tree(corpus)}, {_SHADOW} SELECT hash, typ, path, size, shadowed FROM flagged")(
            lambda spark, sf_dir, c=corpus: _analysis(spark, sf_dir, c).flagged.select("hash", "typ", "path", "size", "shadowed"))
    for corpus, rules in (("orders", (0, 1, 2, 3)), ("events", (2,))):
        for rule in rules:
            sql = f"WITH {_base(corpus)}, {_tree(corpus)}, {_SHADOW}, {_VISIBLE.format(hide=groups.HIDE[rule])} SELECT hash, typ, path, size, shadowed, n, ns FROM shown"
            query(f"groups_rule{rule}_{corpus}", sql)(lambda spark, sf_dir, c=corpus,
                r=rule: _analysis(spark, sf_dir, c).shown(r).select("hash", "typ", "path", "size", "shadowed", "n", "ns"))


_register_directories()


@query(
    "export_order_docs",
    f"WITH {_base('docs')}, {_tree('docs')}, {_SHADOW}, {_VISIBLE.format(hide='false')}, "
    "heads AS (SELECT hash, max(size) AS gsize, min({'t': typ_order, 'p': string_split(path,'/')}) AS head FROM shown GROUP BY hash), "
    "ranks AS (SELECT hash, row_number() OVER (ORDER BY gsize DESC, head) AS group_rank FROM heads) "
    "SELECT group_rank, (row_number() OVER (PARTITION BY s.hash ORDER BY typ_order, string_split(path,'/')))::INTEGER AS member_rank, path, typ, size, shadowed FROM shown s JOIN ranks USING (hash)",
)
def export_order_docs(spark, sf_dir):
    return _analysis(spark, sf_dir, "docs").report(0).select("group_rank", "member_rank", "path", "typ", "size", "shadowed")


# ---------------------------------------------------------------- listings

_NODES = """nodes AS (SELECT path, file_hash AS h, file_size AS size, 'F' AS icon, 2 AS prio FROM files UNION ALL SELECT path, dir_hash, dir_size, 'D', 0 FROM dirs),
hcount AS (SELECT hash, count(*) AS copies FROM members GROUP BY hash),
labelled AS (SELECT n.*, coalesce(copies > 1, false) AS dup FROM nodes n LEFT JOIN hcount ON n.h = hcount.hash),
ups AS (SELECT path, unnest({anc}) AS above FROM labelled),
hidden AS (SELECT DISTINCT u.path FROM ups u JOIN labelled l ON u.above = l.path AND l.dup),
seen AS (SELECT *, regexp_replace(path,'/[^/]*$','') AS parent_path, string_split(path,'/')[-1] AS name FROM labelled WHERE path <> '' AND path NOT IN (SELECT path FROM hidden))""".format(anc=_ANCESTORS)


@query(
    "tree_listing_events",
    f"WITH {_base('events')}, {_tree('events')}, {_NODES} SELECT path, parent_path, CASE WHEN dup THEN 'DUPS' ELSE 'UNIQ' END AS label, icon, name, coalesce(size,0)::BIGINT AS size, "
    "(row_number() OVER (PARTITION BY parent_path ORDER BY prio, dup DESC, coalesce(size,0) DESC, name))::INTEGER AS child_rank FROM seen",
)
def tree_listing_events(spark, sf_dir):
    a = _analysis(spark, sf_dir, "events")
    return reports.tree_listing(diff.nodes_of(a.files, a.dirs), a.members)


@query(
    "tree_dups_top4_orders",
    f"WITH {_base('orders')}, {_tree('orders')}, {_NODES}, ranked AS (SELECT hash, path AS member, (row_number() OVER (PARTITION BY hash ORDER BY typ_order, string_split(path,'/')))::INTEGER AS member_rank FROM members) "
    "SELECT s.path, r.member_rank, r.member FROM seen s JOIN ranked r ON s.h = r.hash WHERE s.dup AND r.member_rank <= 4",
)
def tree_dups_top4_orders(spark, sf_dir):
    a = _analysis(spark, sf_dir, "orders")
    nodes = diff.nodes_of(a.files, a.dirs)
    return reports.first_members(reports.tree_listing(nodes, a.members), nodes, a.members)


def _diff_sql(roots: tuple[str, ...], select: str) -> str:
    listed = ", ".join(f"'{r}'" for r in roots)
    return f"""WITH {_base('flags')}, {_tree('flags')},
nodes AS (SELECT path, file_hash, NULL AS dir_hash, file_size AS size, false AS is_dir FROM files UNION ALL SELECT path, NULL, dir_hash, dir_size, true FROM dirs),
own AS (SELECT array_to_string(string_split(path,'/')[1:3],'/') AS root, array_to_string(string_split(path,'/')[4:],'/') AS rel, * FROM nodes WHERE len(string_split(path,'/')) >= 3),
picked AS (SELECT * FROM own WHERE root IN ({listed})),
equal AS (SELECT DISTINCT a.root, a.rel FROM picked a JOIN picked b ON a.rel = b.rel AND a.root <> b.root AND CASE WHEN a.file_hash IS NOT NULL AND b.file_hash IS NOT NULL THEN a.file_hash = b.file_hash ELSE a.dir_hash = b.dir_hash END),
marked AS (SELECT p.*, e.root IS NOT NULL AS eq FROM picked p LEFT JOIN equal e ON p.root = e.root AND p.rel = e.rel),
leaves AS (SELECT root, rel, eq FROM marked WHERE NOT is_dir),
cover AS (SELECT root, up AS rel, bool_and(eq) AS covered FROM (SELECT root, eq, unnest(['', string_split(rel,'/')[1]]) AS up FROM leaves) GROUP BY ALL),
stated AS (SELECT m.root, m.rel, m.is_dir, m.size, CASE WHEN eq THEN 2 WHEN m.is_dir AND coalesce(covered, true) THEN 1 ELSE 0 END AS stat FROM marked m LEFT JOIN cover c ON m.root = c.root AND m.rel = c.rel),
tops AS (SELECT root, rel FROM stated WHERE stat = 2),
hidden AS (SELECT DISTINCT s.root, s.rel FROM (SELECT root, rel, unnest(['', string_split(rel,'/')[1]]) AS up FROM stated WHERE rel <> '') s JOIN tops t ON s.root = t.root AND s.up = t.rel AND s.rel <> t.rel),
listed AS (SELECT s.root, s.rel, s.stat, CASE s.stat WHEN 2 THEN 'DUPS' WHEN 1 THEN 'SUPR' ELSE 'UNIQ' END AS label, CASE WHEN s.is_dir THEN 'D' ELSE 'F' END AS icon, coalesce(s.size,0)::BIGINT AS size
  FROM stated s LEFT JOIN hidden h ON s.root = h.root AND s.rel = h.rel WHERE h.root IS NULL)
{select}"""


def _flag_diff(spark, sf_dir, roots) -> DataFrame:
    a = _analysis(spark, sf_dir, "flags")
    return diff.tree_diff(diff.nodes_of(a.files, a.dirs), roots)


_TWO, _THREE = ("/flags/A", "/flags/R"), ("/flags/A", "/flags/N", "/flags/R")


@query("diff_flags_2roots", _diff_sql(_TWO, "SELECT * FROM listed"))
def diff_flags_2roots(spark, sf_dir):
    return diff.displayed(_flag_diff(spark, sf_dir, _TWO))


@query("diff_flags_3roots", _diff_sql(_THREE, "SELECT * FROM listed"))
def diff_flags_3roots(spark, sf_dir):
    return diff.displayed(_flag_diff(spark, sf_dir, _THREE))


@query("diff_summary", _diff_sql(_THREE, "SELECT root, is_dir, stat, count(*) AS n, coalesce(sum(size),0)::BIGINT AS bytes FROM stated GROUP BY ALL"))
def diff_summary(spark, sf_dir):
    return _flag_diff(spark, sf_dir, _THREE).groupBy("root", "is_dir", "stat").agg(F.count("*").alias("n"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


# ---------------------------------------------------------------- dedup plans

_DEDUP = """fit AS (SELECT file_hash AS hash, path, file_size, phys, n_extents, ctime FROM files WHERE file_hash IS NOT NULL AND file_size > 0 AND phys IS NOT NULL AND phys <> 0 AND n_extents IS NOT NULL),
cand AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n, (sum(phys) OVER (PARTITION BY hash) // count(*) OVER (PARTITION BY hash))::BIGINT AS avg_phys, count(*) OVER (PARTITION BY hash, phys) AS occurrences FROM fit QUALIFY n > 1),
elected AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY n_extents, occurrences DESC, ctime, abs(avg_phys-phys), phys, string_split(path,'/')) AS place FROM cand),
keep AS (SELECT hash, path AS keeper, phys AS keeper_phys, avg_phys, n FROM elected WHERE place = 1),
dup AS (SELECT c.hash, k.keeper, k.avg_phys, c.path, c.phys, c.file_size FROM cand c JOIN keep k USING (hash) WHERE c.path <> k.keeper {retain})"""
_RETAIN = "AND c.phys <> k.keeper_phys"
_PLAN = "SELECT hash, keeper, file_size, avg_phys, count(*) AS n_dups, file_size*(count(*)+1) AS usage FROM dup GROUP BY hash, keeper, file_size, avg_phys"


def _dedup_sql(corpus: str, select: str, retain: str = _RETAIN) -> str:
    return f"WITH {_base(corpus)}, {_DEDUP.format(retain=retain)} {select}"


def _dedup(spark, sf_dir, corpus: str) -> DataFrame:
    return dedup.dedup_candidates(_analysis(spark, sf_dir, corpus).files)


@query("dedup_candidates_orders", _dedup_sql("orders", "SELECT hash, path, phys, occurrences, n, avg_phys FROM cand"))
def dedup_candidates_orders(spark, sf_dir):
    return _dedup(spark, sf_dir, "orders").select("hash", "path", "phys", "occurrences", "n", "avg_phys")


@query("dedup_keeper_orders", _dedup_sql("orders", "SELECT hash, keeper, keeper_phys, avg_phys, n FROM keep"))
def dedup_keeper_orders(spark, sf_dir):
    return dedup.keepers(_dedup(spark, sf_dir, "orders")).select("hash", "keeper", "keeper_phys", "avg_phys", "n")


@query("dedup_groups_orders", _dedup_sql("orders", _PLAN))
def dedup_groups_orders(spark, sf_dir):
    return dedup.group_plan(dedup.dedup_groups(_dedup(spark, sf_dir, "orders")))


@query("dedup_groups_aggressive_orders", _dedup_sql("orders", _PLAN, ""))
def dedup_groups_aggressive_orders(spark, sf_dir):
    return dedup.group_plan(dedup.dedup_groups(_dedup(spark, sf_dir, "orders"), aggressive=True))


@query("dedup_reclaimable_docs", _dedup_sql("docs", _PLAN))
def dedup_reclaimable_docs(spark, sf_dir):
    return dedup.group_plan(dedup.dedup_groups(_dedup(spark, sf_dir, "docs")))


@query("dedup_simulate_orders",
    _dedup_sql("orders", "SELECT count(DISTINCT hash) AS groups, count(*) AS dup_files, coalesce(sum(file_size),0)::BIGINT AS dup_bytes FROM dup"))
def dedup_simulate_orders(spark, sf_dir):
    return dedup.simulate(dedup.dedup_groups(_dedup(spark, sf_dir, "orders")))


# The fold over groups by recursion; a row emits a share, ends a batch, or both.
_FOLD = """plan AS ({plan}), numbered AS (SELECT *, row_number() OVER (ORDER BY avg_phys, hash) AS k FROM plan),
fold(k, pos, files, used, batch, made, hash, first, last, usage) AS (
  SELECT 1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT CASE WHEN fits OR (NOT closes AND until = n_dups) THEN k + 1 ELSE k END, CASE WHEN fits OR (NOT closes AND until = n_dups) THEN 0 WHEN closes THEN pos ELSE until END,
         CASE WHEN fits THEN files + n_dups - pos + 1 ELSE 0 END, CASE WHEN fits THEN used + (n_dups - pos + 1) * file_size ELSE 0 END, CASE WHEN fits THEN batch ELSE batch + 1 END,
         CASE WHEN NOT closes THEN batch END, CASE WHEN NOT closes THEN name END, CASE WHEN NOT closes THEN pos END, CASE WHEN NOT closes THEN CASE WHEN fits THEN n_dups ELSE until END - 1 END,
         CASE WHEN NOT closes THEN (CASE WHEN fits THEN n_dups ELSE until END - pos + 1) * file_size END
  FROM (SELECT *, NOT fits AND files > 0 AS closes FROM (
    SELECT f.k, f.pos, f.files, f.used, f.batch, p.hash AS name, p.n_dups, p.file_size, f.files + p.n_dups - f.pos + 1 <= 127 AND f.used + (p.n_dups - f.pos + 1) * p.file_size <= {budget} AS fits,
           least(p.n_dups, f.pos + greatest(2, least(127, {budget} // greatest(p.file_size, 1))) - 1) AS until
    FROM fold f JOIN numbered p ON f.k = p.k))
)
SELECT 0 AS shard, made AS batch, hash, first, last, usage FROM fold WHERE made IS NOT NULL"""


def _register_batches() -> None:
    for corpus, budget in (("docs", 24 << 10), ("orders", 300)):
        sql = _dedup_sql(corpus, "").replace("WITH raw", "WITH RECURSIVE raw", 1) + ", " + _FOLD.format(plan=_PLAN, budget=budget)

        def batches(spark, sf_dir, c=corpus, b=budget):
            return dedup.batches(dedup.group_plan(dedup.dedup_groups(_dedup(spark, sf_dir, c))), budget=b)

        query(f"dedup_batches_{corpus}", sql)(batches)


_register_batches()


@query("dedup_read_order_orders",
    _dedup_sql("orders", "SELECT path, phys, phys % 50 AS batch, row_number() OVER (PARTITION BY phys % 50 ORDER BY phys, path)::INTEGER AS read_order FROM dup"))
def dedup_read_order_orders(spark, sf_dir):
    rows = dedup.dedup_groups(_dedup(spark, sf_dir, "orders")).withColumn("batch", F.col("phys") % 50)
    return dedup.read_order(rows).select("path", "phys", "batch", "read_order")


# ---------------------------------------------------------------- cache


def _cached_docs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A scan, and a cache in which each 7th entry is missing, each 5th has another time and each 3rd another size."""
    scanned = corpora.docs(spark, sf_dir)
    number = F.col("phys") - 1
    cached = scanned.where(number % 7 != 0).select("path", F.when(number % 5 == 0, F.col("ctime") + 1).otherwise(F.col("ctime")).alias("ctime"),
        F.when(number % 3 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), F.sha2("content", 256).alias("file_hash"))
    return scanned, cached


_VALID = "((phys-1) % 7 <> 0 AND (phys-1) % 5 <> 0 AND (phys-1) % 3 <> 0)"


@query("cache_validate_docs", f"WITH {_base('docs')} SELECT path, {_VALID} AS valid, CASE WHEN {_VALID} THEN sha256(content) END AS file_hash FROM entries")
def cache_validate_docs(spark, sf_dir):
    return cache.validate(*_cached_docs(spark, sf_dir)).select("path", "valid", "file_hash")


@query("cache_reuse_docs",
    f"WITH {_base('docs')} SELECT path, CASE WHEN {_VALID} OR file_size IN (SELECT file_size FROM shared) THEN sha256(content) END AS file_hash, NOT {_VALID} AND file_size IN (SELECT file_size FROM shared) AS read_again FROM entries")
def cache_reuse_docs(spark, sf_dir):
    wanted = candidates.read_candidates(cache.validate(*_cached_docs(spark, sf_dir)))
    return candidates.content_hashes(wanted.withColumn("read_again", F.col("candidate"))).select("path", "file_hash", "read_again")


# ---------------------------------------------------------------- scalars and small joins


@query("archive_extension_filter_pages",
    "SELECT url, regexp_matches(name, '(\\.zip|\\.tar|\\.7z|\\.tar\\.gz|\\.tar\\.xz)$') AS archive FROM (SELECT url, url || ['.zip','.tar.gz','.ZIP','.tgz','.tar.xz','.7z','.html'][(page_id % 7 + 1)::INTEGER] AS name FROM pages)")
def archive_extension_filter_pages(spark, sf_dir):
    endings = F.array(*map(F.lit, (".zip", ".tar.gz", ".ZIP", ".tgz", ".tar.xz", ".7z", ".html")))
    name = F.concat("url", F.element_at(endings, (F.col("page_id") % 7 + 1).cast("int")))
    return corpora.table(spark, sf_dir, "pages").select("url", P.is_archive_name(name).alias("archive"))


@query(
    "human_size_docs",
    "WITH s AS (SELECT doc_id, strlen(text)::BIGINT * (1 + doc_id * doc_id * doc_id) AS size FROM documents), "
    "u AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 WHEN size < 1099511627776 THEN 3 ELSE 4 END AS p FROM s), "
    "t AS (SELECT *, floor(size * 10 / pow(1024::DOUBLE, p))::BIGINT AS tenths FROM u) "
    "SELECT doc_id, size, CASE WHEN p = 0 THEN size || ' B' ELSE (tenths // 10) || '.' || (tenths % 10) || ' ' || ['KiB','MiB','GiB','TiB'][p] END AS shown FROM t",
)
def human_size_docs(spark, sf_dir):
    """Sizes that no long holds (from 100 KB texts at id 45,000 on) are null; what is shown is exact for them too."""
    id_ = F.col("doc_id").cast("decimal(38,0)")
    exact = F.octet_length("text").cast("decimal(10,0)") * (1 + id_ * id_ * id_)
    sized = corpora.table(spark, sf_dir, "documents").select("doc_id", exact.alias("exact"))
    return sized.select("doc_id", F.col("exact").try_cast("long").alias("size"), S.human_size(F.col("exact"), units=4).alias("shown"))


@query("path_prefix_strip",
    f"WITH {_base('docs')} SELECT path, CASE WHEN starts_with(path,'/docs/src1/') THEN substr(path,12) ELSE path END AS shown FROM entries")
def path_prefix_strip(spark, sf_dir):
    return corpora.docs(spark, sf_dir).select("path", P.display_path(F.col("path"), ["/docs/src1"], False).alias("shown"))


@query(
    "path_component_sort",
    "WITH p AS (SELECT '/r/' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '.' END || c_custkey AS path, c_mktsegment FROM customer) "
    "SELECT path, row_number() OVER (PARTITION BY c_mktsegment ORDER BY string_split(path,'/'))::INTEGER AS place FROM p",
)
def path_component_sort(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = corpora.table(spark, sf_dir, "customer").select("c_mktsegment", F.concat(F.lit("/r/"), "c_mktsegment",
        F.when(F.col("c_custkey") % 2 == 0, "/").otherwise("."), F.col("c_custkey")).alias("path"))
    return rows.select("path", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(P.components(F.col("path")))).alias("place"))


@query(
    "range_join_chunks",
    "WITH chunk AS (SELECT (s_suppkey * 50)::BIGINT AS start, 40::BIGINT AS length, (s_suppkey * 1000)::BIGINT AS physical FROM supplier) "
    "SELECT DISTINCT l.l_orderkey AS address, c.physical + l.l_orderkey - c.start AS physical FROM lineitem l LEFT JOIN chunk c ON l.l_orderkey BETWEEN c.start AND c.start + c.length - 1",
)
def range_join_chunks(spark, sf_dir):
    from .operators.ranges import to_physical

    chunk = corpora.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 50).alias("start"), F.lit(40).cast("long").alias("length"),
        (F.col("s_suppkey") * 1000).alias("physical"))
    asked = corpora.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("address")).distinct()
    return to_physical(asked, chunk)


@query(
    "recursive_path_build",
    "WITH RECURSIVE t(id, parent, name) AS (SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN NULL ELSE s_suppkey // 2 END, s_name FROM supplier), "
    "walk(id, path) AS (SELECT id, '/' || name FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t) OR parent = id UNION ALL SELECT t.id, w.path || '/' || t.name FROM t JOIN walk w ON t.parent = w.id AND t.id <> t.parent) SELECT id, path FROM walk",
)
def recursive_path_build(spark, sf_dir):
    from .operators.ranges import build_paths

    key = F.col("s_suppkey")
    return build_paths(corpora.table(spark, sf_dir, "supplier").select(key.alias("id"), F.when(key != 0, F.floor(key / 2)).alias("parent"),
        F.col("s_name").alias("name")))


@query(
    "bitmask_group_profile",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN f & 1 <> 0 THEN 'data' END, CASE WHEN f & 2 <> 0 THEN 'system' END, CASE WHEN f & 4 <> 0 THEN 'metadata' END], lambda x: x IS NOT NULL), ',') AS type, "
    "CASE WHEN f & 8 <> 0 THEN 'raid0' WHEN f & 16 <> 0 THEN 'raid1' WHEN f & 32 <> 0 THEN 'dup' WHEN f & 64 <> 0 THEN 'raid10' WHEN f & 128 <> 0 THEN 'raid5' WHEN f & 256 <> 0 THEN 'raid6' ELSE 'single' END AS profile FROM (SELECT p_partkey, p_partkey % 512 AS f FROM part)",
)
def bitmask_group_profile(spark, sf_dir):
    flags = F.col("p_partkey") % 512
    return corpora.table(spark, sf_dir, "part").select("p_partkey", S.group_type(flags).alias("type"), S.group_profile(flags).alias("profile"))


@query("profile_codes_part",
    "SELECT p_partkey, CASE WHEN f & 8 <> 0 THEN 8 WHEN f & 16 <> 0 THEN 16 WHEN f & 32 <> 0 THEN 32 WHEN f & 64 <> 0 THEN 64 WHEN f & 128 <> 0 THEN 128 WHEN f & 256 <> 0 THEN 256 ELSE 0 END AS code FROM (SELECT p_partkey, p_partkey % 512 AS f FROM part)")
def profile_codes_part(spark, sf_dir):
    return corpora.table(spark, sf_dir, "part").select("p_partkey", S.profile_code(S.group_profile(F.col("p_partkey") % 512)).alias("code"))


@query("decompressed_docs",
    "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN sha256(coalesce(text, '')) END AS digest, CASE WHEN doc_id % 3 = 2 THEN 'no decoder for lzo' END AS error FROM documents")
def decompressed_docs(spark, sf_dir):
    """Texts as extents: plain, as a zlib stream after 8 bytes of lengths, and of a kind without a decoder."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples(index=False):
                raw, kind = (r.text or "").encode(), r.doc_id % 3
                stream = zlib.compressobj(wbits=-15)
                made.append((r.doc_id, kind, bytes(8) + stream.compress(raw) + stream.flush() if kind == 1 else raw, len(raw)))
            yield pd.DataFrame(made, columns=["doc_id", "kind", "data", "size"])

    rows = corpora.table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(packed, "doc_id long, kind int, data binary, size long")
    out = rows.select("doc_id", S.decompressed("kind", "data", "size").alias("d"))
    return out.select("doc_id", F.sha2("d.data", 256).alias("digest"), "d.error")


@query("base64_roundtrip", "SELECT doc_id, sha256(text) AS decoded, NULL::VARCHAR AS too_long FROM documents")
def base64_roundtrip(spark, sf_dir):
    coded = F.base64(F.unhex(F.sha2("text", 256)))
    return corpora.table(spark, sf_dir, "documents").select("doc_id", S.decode_hash(F.regexp_replace(coded, "=", "")).alias("decoded"),
        S.decode_hash(F.concat(coded, coded)).alias("too_long"))


# The checksum by its table, byte after byte.
_CRC = """WITH RECURSIVE steps(value, crc, k) AS (
  SELECT value, value::UBIGINT, 0 FROM (SELECT unnest(range(256)) AS value) UNION ALL SELECT value, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 2197175160::UBIGINT) ELSE crc >> 1 END, k + 1 FROM steps WHERE k < 8
), tables AS (SELECT list(crc ORDER BY value) AS t FROM steps WHERE k = 8),
named AS (SELECT p_partkey, list_transform(range(strlen(p_name)), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i + 1, 2))::UBIGINT) AS b, t FROM part, tables)
SELECT p_partkey, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS crc,
       list_reduce(b, lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT]), 4294967294::UBIGINT)::BIGINT AS name_hash FROM named"""


@query("crc32c_names", _CRC)
def crc32c_names(spark, sf_dir):
    name = F.col("p_name").cast("binary")
    return corpora.table(spark, sf_dir, "part").select("p_partkey", S.crc32c(name).alias("crc"), S.name_hash(name).alias("name_hash"))


# ---------------------------------------------------------------- images and archives made of tables

#: Rows that go into one image or archive.
IMAGE_ROWS, ARCHIVE_ROWS = 10_000, 200


def _images(rows: DataFrame, key: str, items: Callable[[Iterator], list[imagebuild.Item]]) -> DataFrame:
    """Items read back from images of at most IMAGE_ROWS rows each (keys are numbers without gaps); items: rows to items of the file tree."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"image": [f"image-{frame['__image'].iloc[0]}"], "content": [imagebuild.image_of({5: items(frame.itertuples(index=False))})]})

    made = rows.withColumn("__image", F.floor(F.col(key) / IMAGE_ROWS)).groupBy("__image").applyInPandas(build, "image string, content binary")
    return imagefs.read_image_bytes(made)


def _nation_items(rows: Iterator) -> list[imagebuild.Item]:
    found: dict[tuple[int, int, int], bytes] = {}
    for r in rows:
        parent, child, made = 256 + r.n_regionkey, 1000 + r.n_nationkey, imagebuild.entry(1000 + r.n_nationkey, r.n_name, "directory"
            if r.n_nationkey % 2 else "file")
        found[parent, 96, 2 + r.n_nationkey] = made
        place = (parent, 84, imagebuild.name_offset(r.n_name))
        found[place] = found.get(place, b"") + made
        found[child, 12, parent] = imagebuild.struct.pack("<QH", 2 + r.n_nationkey, len(r.n_name.encode())) + r.n_name.encode()
    return [(*key, payload) for key, payload in found.items()]


def _supplier_items(rows: Iterator) -> list[imagebuild.Item]:
    return [(1000 + r.s_suppkey, 1, 0, imagebuild.inode(100 * r.s_suppkey, 1_000_000 + r.s_nationkey)) for r in rows]


def _part_items(rows: Iterator) -> list[imagebuild.Item]:
    made = [(r, imagebuild.regular_extent(4096 * r.p_partkey, 4096 * (1 + r.p_size)) if r.p_partkey % 3
        else imagebuild.inline_extent(r.p_name.encode())) for r in rows]
    return [(1000 + r.p_partkey, 108, 0, payload) for r, payload in made]


@query("image_dir_entries_nation",
    "SELECT 256 + n_regionkey::BIGINT AS parent, 2 + n_nationkey::BIGINT AS place, 1000 + n_nationkey::BIGINT AS child, n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN 'directory' ELSE 'file' END AS file_kind, NULL::VARCHAR AS corrupt FROM nation")
def image_dir_entries_nation(spark, sf_dir):
    found = imagefs.dir_entries(_images(corpora.table(spark, sf_dir, "nation"), "n_nationkey", _nation_items))
    return found.select(F.col("object_id").alias("parent"), F.col("offset").alias("place"), "child", "name", "file_kind", "corrupt")


@query("image_entry_by_name_nation",
    "SELECT 256 + n_regionkey::BIGINT AS parent, n_name AS name, 1000 + n_nationkey::BIGINT AS child FROM nation WHERE n_nationkey % 3 = 0")
def image_entry_by_name_nation(spark, sf_dir):
    rows = corpora.table(spark, sf_dir, "nation")
    wanted = rows.where("n_nationkey % 3 = 0").select(F.lit(5).cast("long").alias("tree_id"),
        (256 + F.col("n_regionkey")).cast("long").alias("object_id"), F.col("n_name").alias("name"))
    return imagefs.entry_by_name(_images(rows, "n_nationkey", _nation_items), wanted).select(F.col("object_id").alias("parent"), "name", "child")


@query("image_inode_refs_nation",
    "SELECT 1000 + n_nationkey::BIGINT AS object_id, 256 + n_regionkey::BIGINT AS parent, 2 + n_nationkey::BIGINT AS index, n_name AS name FROM nation")
def image_inode_refs_nation(spark, sf_dir):
    return imagefs.inode_refs(_images(corpora.table(spark, sf_dir, "nation"), "n_nationkey", _nation_items)).select("object_id", "parent", "index", "name")


@query("image_inodes_supplier",
    "SELECT 1000 + s_suppkey AS object_id, 100 * s_suppkey AS st_size, 33188::BIGINT AS st_mode, (1000000 + s_nationkey)::BIGINT AS mtime FROM supplier")
def image_inodes_supplier(spark, sf_dir):
    found = imagefs.inodes(_images(corpora.table(spark, sf_dir, "supplier"), "s_suppkey", _supplier_items))
    return found.select("object_id", "st_size", "st_mode", "mtime")


@query("image_extents_part",
    "SELECT 1000 + p_partkey AS object_id, CASE WHEN p_partkey % 3 = 0 THEN 'inline' ELSE 'regular' END AS kind, CASE WHEN p_partkey % 3 <> 0 THEN 4096 * p_partkey END AS address, CASE WHEN p_partkey % 3 <> 0 THEN (4096 * (1 + p_size))::BIGINT END AS extent_bytes, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS inline FROM part")
def image_extents_part(spark, sf_dir):
    found = imagefs.extents(_images(corpora.table(spark, sf_dir, "part"), "p_partkey", _part_items))
    return found.select("object_id", "kind", "address", "extent_bytes", F.col("inline").cast("string").alias("inline"))


@query("image_item_counts_part",
    "SELECT t.tree_id, t.item_type, t.n FROM (SELECT 5::BIGINT AS tree_id, 108 AS item_type, count(*) AS n FROM part UNION ALL SELECT 1, 132, count(DISTINCT p_partkey // 10000) FROM part) t")
def image_item_counts_part(spark, sf_dir):
    items = _images(corpora.table(spark, sf_dir, "part"), "p_partkey", _part_items)
    return items.groupBy("tree_id", "item_type").agg(F.count("*").alias("n"))


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """Texts as one archive; the kind goes by the archive's number."""
    number, made = int(frame["archive"].iloc[0]), io.BytesIO()
    files = [(f"d/{r.doc_id}", (r.text or "").encode()) for r in frame.itertuples(index=False)]
    if number % 2:
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files:
                z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data)
    else:
        with tarfile.open(fileobj=made, mode="w:gz") as t:
            for name, data in files:
                info = tarfile.TarInfo(name)
                info.size, info.mtime = len(data), 946684800
                t.addfile(info, io.BytesIO(data))
    return pd.DataFrame({"path": [f"/a/{number}.{'zip' if number % 2 else 'tar.gz'}"], "content": [made.getvalue()]})


@query("archive_members_docs",
    "SELECT '/a/' || (doc_id // 200) || CASE WHEN doc_id // 200 % 2 = 1 THEN '.zip' ELSE '.tar.gz' END || '/d/' || doc_id AS path, strlen(coalesce(text, ''))::BIGINT AS file_size, sha256(coalesce(text, '')) AS file_hash, 946684800::BIGINT AS mtime FROM documents")
def archive_members_docs(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / ARCHIVE_ROWS).alias("archive"))
    found = archive.read_archive_bytes(docs.groupBy("archive").applyInPandas(_packed, "path string, content binary"))
    times = found.select(F.concat_ws("/", "archive_path", "member").alias("path"), "mtime")
    return archive.member_entries(found).select("path", "file_size", "file_hash").join(times, "path")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups of the document tree under the default rule, in report order."""
    return _analysis(spark, sf_dir, "docs").report().select("group_rank", "member_rank", "typ", "path", "size", "shadowed")
