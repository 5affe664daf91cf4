"""Every query over the fixture graph, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph, inventory, merge, search, security
from ..sources import rules as rule_source
from .fixture import Fixture, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *, fixture: bool = True):
    """Register a function of a Fixture under its own name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture.of(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql) if fixture else sql
        return f

    return register


# --- graph navigation

@query("select target as method, source as caller, n.kind from calls join nodes n on n.id = source")
def callers_direct(g):
    return graph.callers_direct(g.calls, g.nodes)


@query("select source as method, target as callee, n.id is null as external from calls left join nodes n on n.id = target")
def callees_direct(g):
    return graph.callees_direct(g.calls, g.nodes)


@query("select distinct o.source as method, c.source as caller from ovr o join calls c on c.target = o.target where not exists (select 1 from calls d where d.target = o.source and d.source = c.source)")
def callers_virtual(g):
    return graph.callers_virtual(g.calls, g.overrides)


@query("select distinct c.source as method, o.source as callee from calls c join ovr o on o.target = c.target where not exists (select 1 from calls d where d.source = c.source and d.target = o.source)")
def callees_virtual(g):
    return graph.callees_virtual(g.calls, g.overrides)


@query("select m, caller, rk from rev")
def caller_step(g):
    return graph.caller_step(g.calls, g.overrides)


@query("select t, a from anc")
def ancestor_closure(g):
    return graph.ancestor_closure(g.supers)


@query("select distinct source, target from ovr")
def override_edges(g):
    return graph.override_edges(g.closure, g.mth)


@query("select * from nodes where id in ('C:geo/R1', 'M:geo/R1#ship(I)V', 'C:nowhere', 'M:app/sup/S3#ship(I)V')")
def node_by_id(g):
    return g.nodes.where(F.col("id").isin("C:geo/R1", "M:geo/R1#ship(I)V", "C:nowhere", "M:app/sup/S3#ship(I)V"))


@query("select id, name from nodes where kind = 'method' and name = 'ship' and owner like 'geo/%'")
def resolve_methods(g):
    hits = search.like_hits(g.nodes, "ship").where("kind = 'method' and name = 'ship'")
    return hits.where(names.in_prefix(F.col("id"), names.scope_prefix("geo."))).select("id", "name")


@query("""select c.id as class_id, c.kind as class_kind, m.id as member, m.start_line, m.end_line, cast(row_number() over (partition by c.id order by m.name, m.id) as int) as k
 from nodes c left join nodes m on m.owner = substr(c.id, 3) and m.kind = 'method' where c.kind <> 'method'""")
def outline(g):
    classes = g.nodes.where("kind <> 'method'").select(F.col("id").alias("class_id"), F.col("kind").alias("class_kind"))
    methods = g.nodes.where("kind = 'method'").select(names.class_id(F.col("owner")).alias("class_id"), F.col("id").alias("member"), "name", "start_line", "end_line")
    rows = classes.join(methods, "class_id", "left")
    return merge.numbered(rows, ["class_id"], ["name", "member"]).select("class_id", "class_kind", "member", "start_line", "end_line", "k")


@query("""select id, kind, file_path, k, method from (select c.id, c.kind, c.file_path, m.id as method, cast(row_number() over (partition by c.id order by m.name, m.id) as int) as k
 from (select * from nodes where kind <> 'method' and lower(id) like '%app/cust/c1%' order by length(name), id limit 10) c left join nodes m on m.owner = substr(c.id, 3)) where k <= 20""")
def node_details(g):
    hits = g.nodes.where("kind <> 'method'").where(F.lower("id").contains("app/cust/c1")).orderBy(F.length("name"), "id").limit(10)
    methods = g.nodes.where("kind = 'method'").select(F.col("owner").alias("owner_key"), F.col("id").alias("method"), F.col("name").alias("m_name"))
    rows = hits.withColumn("owner_key", F.substring("id", 3, 1 << 20)).join(methods, "owner_key", "left")
    return merge.numbered(rows, ["id"], ["m_name", "method"]).where("k <= 20").select("id", "kind", "file_path", "k", "method")


@query("""select h.id, coalesce(array_to_string(list_slice(list(r.caller order by r.rk, r.caller) filter (where r.caller is not null), 1, 5), ','), '') as callers, count(r.caller) as n_callers,
 (select count(*) from calls c where c.source = h.id) as n_callees from (select id from nodes where kind = 'method' and name = 'ship' order by id limit 4) h left join rev r on r.m = h.id group by h.id""")
def context_bundle(g):
    hits = g.nodes.where("kind = 'method' and name = 'ship'").orderBy("id").limit(4).select("id")
    step = graph.caller_step(g.calls, g.overrides, hits.select(F.col("id").alias("method")))
    callers = hits.join(step, F.col("id") == F.col("m")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rk", "caller"))).alias("c"))
    callees = hits.join(g.calls, F.col("id") == F.col("source")).groupBy("id").agg(F.count("*").alias("n_callees"))
    rows = hits.join(callers, "id", "left").join(callees, "id", "left")
    nothing = F.lit(0).cast("long")
    return rows.select("id", F.coalesce(F.array_join(F.slice(F.col("c.caller"), 1, 5), ","), F.lit("")).alias("callers"), F.coalesce(F.size("c").cast("long"), nothing).alias("n_callers"), F.coalesce("n_callees", nothing).alias("n_callees"))


# --- recursion

_STARTS = "select id as start from nodes where kind = 'method' and name = 'ship' and owner like 'geo/%'"


@query(f""", bfs as (select start, start as id, 0 as depth from ({_STARTS}) union select b.start, r.caller, b.depth + 1 from bfs b join rev r on r.m = b.id where b.depth < 4)
 select start, id, min(depth) as depth from bfs group by 1, 2 having min(depth) > 0""")
def impact_bfs(g):
    starts = g.nodes.where("kind = 'method' and name = 'ship'").where(F.col("owner").startswith("geo/")).select(F.col("id").alias("start"))
    return graph.impact(g.reverse, starts, 4)


@query(f""", p as (select start, start as cur, [start] as path, [''] as key, 1 as depth from ({_STARTS})
  union all select p.start, r.caller, list_append(p.path, r.caller), list_append(p.key, r.rk || r.caller), p.depth + 1 from p join rev r on r.m = p.cur
   where p.depth < 12 and not list_contains(p.path, r.caller) and not (p.depth > 1 and exists (select 1 from srcm where m = p.cur))),
 e as (select *, exists (select 1 from rev where m = cur) as called, exists (select 1 from rev where m = cur and not list_contains(path, caller)) as goes_on, exists (select 1 from srcm where m = cur) as src from p),
 f as (select *, case when depth > 1 and src then 'source' when not called then 'entry' when depth >= 12 then 'depth' when not goes_on then 'cycle' end as terminal from e)
 select start, array_to_string(list_reverse(path), ' > ') as path, terminal, depth, k from (select *, cast(row_number() over (partition by start order by key) as int) as k from f where terminal is not null) where k <= 20""")
def trace_paths(g):
    starts = g.nodes.where("kind = 'method' and name = 'ship'").where(F.col("owner").startswith("geo/")).select(F.col("id").alias("start"))
    return graph.trace(g.reverse, g.source_methods, starts).withColumn("path", F.array_join("path", " > "))


#: Methods of all orders under framework types: names, descriptors, access and known kinds vary with the key.
_HOOKS = """select 'app/H'||o_orderkey as owner,
 case o_orderkey%13 when 0 then 'doGet' when 1 then 'doFancy' when 2 then 'service' when 3 then 'doFilter' when 4 then 'onMessage' when 5 then 'run' when 6 then 'call' when 7 then '<init>' when 8 then 'undo' when 9 then 'services' when 10 then 'dodge' else 'run' end as name,
 case when o_orderkey%5=0 then '(I)V' else '()V' end as descriptor,
 case o_orderkey%11 when 0 then 8 when 1 then 2 when 2 then 9 else 1 end as access,
 case when o_orderkey%17=0 then 'HTTP' end as entry_kind,
 case o_custkey%9 when 0 then 'javax/servlet/http/HttpServlet' when 1 then 'jakarta/servlet/http/HttpServlet' when 2 then 'javax/servlet/Filter' when 3 then 'jakarta/servlet/Filter' when 4 then 'javax/jms/MessageListener' when 5 then 'jakarta/jms/MessageListener' when 6 then 'java/lang/Runnable' when 7 then 'java/util/concurrent/Callable' else 'app/Base' end as ancestor from orders"""


@query(f"""select 'M:' || owner || '#' || name || descriptor as id, kind as entry_kind from (select *,
  case when ancestor like '%/servlet/http/HttpServlet' and (name like 'do%' or name = 'service') then 'SERVLET' when ancestor like '%/servlet/Filter' and name = 'doFilter' then 'FILTER'
   when ancestor like '%/jms/MessageListener' and name = 'onMessage' then 'MQ' when ancestor = 'java/lang/Runnable' and name = 'run' and descriptor = '()V' then 'ASYNC' when ancestor like '%/Callable' and name = 'call' then 'ASYNC' end as kind
  from ({_HOOKS}) h where entry_kind is null and access not in (2, 8, 9) and name <> '<init>') q where kind is not null""")
def entry_from_override(g):
    hooks = g.sql(_HOOKS)
    # The framework type is two steps up.
    supers = hooks.select(F.col("owner").alias("t"), F.concat(F.lit("mid/"), "ancestor").alias("a")).unionByName(hooks.select(F.concat(F.lit("mid/"), "ancestor").alias("t"), F.col("ancestor").alias("a")))
    return security.entries_by_override(hooks.drop("ancestor"), graph.ancestor_closure(supers), security.override_rules(g.spark))


# --- rules and scans

@query("select kind, category, owner, name, seq, source, target from sites")
def call_sites(g):
    return g.sites


@query("select id, kind, category, seq from (select n.id, r.kind, r.category, r.seq, row_number() over (partition by n.id order by r.seq) as k from nodes n join rules r on split_part(n.id, '(', 1) = 'M:' || r.owner || '#' || r.name where n.id like 'M:%') where k = 1")
def rule_first_match(g):
    return security.first_rule(g.nodes.select("id"), g.rules)


@query("select category, source, owner || '#' || s.name as api, target, n.entry_kind from sites s left join nodes n on n.id = s.source where s.kind = 'sink' and coalesce(n.synthetic, 0) = 0".replace("owner ||", "s.owner ||"))
def sinks_scan(g):
    return security.scan(g.sites, g.nodes, "sink")


@query("select category, source, s.owner || '#' || s.name as api, target, n.entry_kind from sites s left join nodes n on n.id = s.source where s.kind = 'source' and lower(category) = 'intake' and coalesce(n.synthetic, 0) = 0")
def sources_scan(g):
    return security.scan(g.sites, g.nodes, "source", category="INTAKE")


@query("select category, count(*) as n from sites s join nodes n on n.id = s.source where s.kind = 'sink' and n.synthetic = 0 group by 1")
def sink_histogram(g):
    return security.histogram(g.sites, g.nodes, "sink")


@query("select category, count(*) as n from sites s join nodes n on n.id = s.source where s.kind = 'source' and n.synthetic = 0 group by 1")
def source_histogram(g):
    return security.histogram(g.sites, g.nodes, "source")


@query("select m from srcm")
def source_methods(g):
    return g.source_methods


@query(""", sk as (select distinct category, source as sink_method, target as sink from sites where kind = 'sink'),
 p as (select start, start as cur, [start] as path, [''] as key, 1 as depth from (select distinct sink_method as start from sk)
  union all select p.start, r.caller, list_append(p.path, r.caller), list_append(p.key, r.rk || r.caller), p.depth + 1 from p join rev r on r.m = p.cur
   where p.depth < 8 and not list_contains(p.path, r.caller) and not (p.depth > 1 and exists (select 1 from srcm where m = p.cur))),
 f as (select * from p where depth >= 8 or (depth > 1 and exists (select 1 from srcm where m = cur)) or not exists (select 1 from rev where m = cur and not list_contains(path, caller))),
 t as (select start, list_reverse(path) as chain from (select *, row_number() over (partition by start order by key) as k from f) where k <= 3),
 c as (select distinct category, sink, sink_method, chain from (select category, sink, sink_method, chain from sk join t on start = sink_method union all select category, sink, sink_method, [sink_method] from sk where sink_method in (select m from srcm)))
 select category, sink, sink_method, array_to_string(chain, ' > ') as chain, seq, total from (select *, row_number() over (order by category, sink, sink_method, chain) as seq, count(*) over () as total from c) where seq <= 600""")
def taint_candidates(g):
    return security.candidate_chains(g.sites, g.reverse, g.source_methods).withColumn("chain", F.array_join("chain", " > ")).withColumn("seq", F.col("seq").cast("long"))


@query("""select id, entry_kind, case entry_kind when 'HTTP' then 0 when 'SERVLET' then 1 when 'FILTER' then 2 when 'MQ' then 3 when 'MAIN' then 4 when 'ASYNC' then 5 else case when entry_kind is null then 100 else 50 end end + case when synthetic = 1 then 10 else 0 end as priority
 from nodes where kind = 'method'""")
def flow_ranking(g):
    return g.nodes.where("kind = 'method'").select("id", "entry_kind", security.flow_priority(F.col("entry_kind"), F.col("synthetic") == 1).alias("priority"))


#: What each annotation of the frameworks makes of a method, and of the methods of a class.
_ON_METHOD = [
    (0, "Lorg/springframework/web/bind/annotation/RequestMapping;", "HTTP"), (1, "Lorg/springframework/web/bind/annotation/GetMapping;", "HTTP"), (2, "Lorg/springframework/web/bind/annotation/PostMapping;", "HTTP"),
    (3, "Lorg/springframework/web/bind/annotation/PutMapping;", "HTTP"), (4, "Lorg/springframework/web/bind/annotation/DeleteMapping;", "HTTP"), (5, "Lorg/springframework/web/bind/annotation/PatchMapping;", "HTTP"),
    (6, "Ljavax/ws/rs/Path;", "HTTP"), (7, "Ljakarta/ws/rs/Path;", "HTTP"), (8, "Ljavax/ws/rs/GET;", "HTTP"), (9, "Ljavax/ws/rs/POST;", "HTTP"), (10, "Ljavax/ws/rs/PUT;", "HTTP"), (11, "Ljavax/ws/rs/DELETE;", "HTTP"),
    (12, "Ljakarta/ws/rs/GET;", "HTTP"), (13, "Ljakarta/ws/rs/POST;", "HTTP"), (14, "Ljakarta/ws/rs/PUT;", "HTTP"), (15, "Ljakarta/ws/rs/DELETE;", "HTTP"),
    (16, "Lorg/springframework/kafka/annotation/KafkaListener;", "MQ"), (17, "Lorg/springframework/amqp/rabbit/annotation/RabbitListener;", "MQ"), (18, "Lorg/springframework/jms/annotation/JmsListener;", "MQ"),
    (19, "Lorg/springframework/cloud/stream/annotation/StreamListener;", "MQ"), (20, "Lorg/springframework/messaging/handler/annotation/MessageMapping;", "MQ"),
    (21, "Lorg/springframework/scheduling/annotation/Scheduled;", "ASYNC"), (22, "Lorg/springframework/scheduling/annotation/Async;", "ASYNC"),
    (23, "Lorg/springframework/amqp/rabbit/annotation/RabbitHandler;", None), (24, "Ljavax/ws/rs/HEAD;", None),
]
_ON_CLASS = [
    (0, "Lorg/springframework/web/bind/annotation/RestController;", "HTTP"), (1, "Lorg/springframework/stereotype/Controller;", "HTTP"), (2, "Lorg/springframework/web/bind/annotation/RequestMapping;", "HTTP"),
    (3, "Ljavax/ws/rs/Path;", "HTTP"), (4, "Ljakarta/ws/rs/Path;", "HTTP"), (5, "Lorg/springframework/stereotype/Service;", None),
]
_table = lambda rows: ", ".join(f"({k}, '{a}', {'null' if kind is None else repr(kind)})" for k, a, kind in rows)
#: Every order is a method, by turns main, an initialiser or another, with or without annotations.
_MARKED = f"""select o_orderkey, case o_orderkey%5 when 0 then 'main' when 1 then '<init>' else 'list' end as name, case when o_orderkey%3=0 then '()V' else '([Ljava/lang/String;)V' end as descriptor,
 cast(case o_orderkey%7 when 0 then 1 when 1 then 2 when 2 then 8 else 9 end as int) as access, m.ann, m.m_kind, c.cls_ann, c.c_kind from orders
 left join (values {_table(_ON_METHOD)}) m(k, ann, m_kind) on m.k = o_custkey%37 left join (values {_table(_ON_CLASS)}) c(k, cls_ann, c_kind) on c.k = (o_orderkey+o_custkey)%11"""
_MAIN_SQL = "case when name = 'main' and descriptor = '([Ljava/lang/String;)V' and access in (8, 9) then 'MAIN' end"
_CLASS_SQL = "case when access = 1 and name not like '<%' then c_kind end"


@query(f"select o_orderkey, coalesce(m_kind, {_MAIN_SQL}, {_CLASS_SQL}) as from_class, coalesce({_MAIN_SQL}, m_kind, {_CLASS_SQL}) as from_source from ({_MARKED}) q")
def entry_classify(g):
    kind = lambda s: security.entry_kind(F.col("name"), F.col("descriptor"), F.col("access"), F.array("ann"), F.array("cls_ann"), from_source=s)
    return g.sql(_MARKED).select("o_orderkey", kind(False).alias("from_class"), kind(True).alias("from_source"))


#: A line for each part: rules in several spellings, comments, blanks and bad ones.
_RULE_TEXT = """select p_partkey as seq, case p_partkey%9 when 0 then '# '||p_name when 1 then '' when 2 then 'sink '||lower(split_part(p_type,' ',1))||' lib/'||replace(p_brand,'#','')||'/P'||p_partkey||'#get' when 3 then '   SINK   sql  java/sql/S'||p_partkey||'#run   # note'
 when 4 then 'source http a/B'||p_partkey||'#get' when 5 then 'other x a/B#c' when 6 then 'sink exec nohash'||p_partkey when 7 then 'sink exec #name' else 'sink exec owner'||p_partkey||'#' end as line from part"""


@query(f"""select lower(p[1]) as kind, p[2] as category, split_part(p[3], '#', 1) as owner, split_part(p[3], '#', 2) as name, seq from (select regexp_split_to_array(trim(line), '\\s+') as p, line, seq
 from ({_RULE_TEXT}) v) q where trim(line) <> '' and trim(line) not like '#%' and len(p) >= 3 and lower(p[1]) in ('sink', 'source') and split_part(p[3], '#', 1) <> '' and split_part(p[3], '#', 2) <> ''""")
def rule_parse(g):
    return rule_source.parse_rules(g.sql(_RULE_TEXT))


# --- scope

@query("select id from nodes where substr(id, 3) like 'app/cust/C1%'")
def scope_prefix(g):
    return g.nodes.where(names.in_prefix(F.col("id"), names.scope_prefix(" app.cust.C1 "))).select("id")


_SUFFIXES = "select replace('cust@C'||c_custkey||'.java','@',chr(92)) as suffix from customer union all select n_nationkey||'.java' from nation"


@query(f"select n.id from nodes n where exists (select 1 from ({_SUFFIXES}) s where n.file_path is not null and ends_with(n.file_path, replace(s.suffix, chr(92), '/')))")
def scope_paths(g):
    # A suffix may start inside a name: 5.java ends N15.java too.
    return inventory.ending_in(g.nodes, "file_path", g.sql(_SUFFIXES).select(F.translate("suffix", "\\", "/").alias("suffix"))).select("id")


_CHANGED = "select case c_custkey%5 when 0 then '# '||c_name when 1 then ' src'||chr(92)||'C'||c_custkey||'.java ' when 2 then '' when 3 then 'b/C'||c_custkey||'.java' else '  # no' end as line from customer"


@query(f"select replace(trim(line), chr(92), '/') as path from ({_CHANGED}) v where trim(line) <> '' and trim(line) not like '#%'")
def changed_list_parse(g):
    return rule_source.parse_changed(g.sql(_CHANGED))


# --- search and text

_ASKED = "select p_partkey, case p_partkey%4 when 0 then p_name||' <init> foo.bar' when 1 then replace(p_name,' ','_')||';a$b' when 2 then p_brand||'  '||p_type else '  ' end as q from part"


@query(f"select p_partkey, array_to_string(list_filter(regexp_split_to_array(q, '[^A-Za-z0-9_$<>]+'), lambda x: x <> ''), '|') as terms from ({_ASKED}) v")
def fts_query_terms(g):
    return g.sql(_ASKED).select("p_partkey", F.array_join(search.query_terms_of(F.col("q")), "|").alias("terms"))


_POST_SQL = " union all ".join(f"select id, '{c}' as field, unnest(range(len(t)))::int as pos, unnest(t) as token from (select id, list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as t from nodes)" for c in search.FIELDS)


@query(f"select id, field, pos, token from ({_POST_SQL})")
def fts_postings(g):
    return search.postings(g.nodes)


@query(f", post as ({_POST_SQL}) select id, cast(count(*) filter (where token = 'ship') as bigint) as tf_ship, cast(count(*) filter (where token = 'r1') as bigint) as tf_r1 from post group by id having tf_ship > 0 and tf_r1 > 0")
def search_fts(g):
    hits = search.term_hits(g.postings, "Ship R1")
    return hits.groupBy("id").agg(F.sum(F.when(F.col("term") == 0, F.col("tf")).otherwise(0)).alias("tf_ship"), F.sum(F.when(F.col("term") == 1, F.col("tf")).otherwise(0)).alias("tf_r1"))


_BM25_SQL = f""", post as ({_POST_SQL}), dl as (select id, count(*) as len from post group by id), st as (select (select count(*) from nodes) as n, (select count(*) from post) as tokens),
 tf as (select id, token, count(*) as tf from post where token in ('ship', 'r1') group by 1, 2), df as (select token, count(*) as df from tf group by 1), full_ids as (select id from tf group by id having count(*) = 2),
 sc as (select tf.id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (tokens / n)))) as score from tf join full_ids using (id) join dl using (id) join df using (token), st group by tf.id)"""


@query(_BM25_SQL + " select id, round(score, 4) as score from sc")
def search_bm25(g):
    return search.bm25(g.nodes, "ship r1", index=g.postings, totals=g.totals()).select("id", F.round("score", 4).alias("score"))


_LIKE_SQL = "select id, name, kind, case when lower(name) = 'c11' then 0 else 1 end as rank from nodes where lower(name) = 'c11' or lower(name) like '%c11%' or lower(coalesce(owner, '')) like '%c11%' or lower(id) like '%c11%' or lower(coalesce(descriptor, '')) like '%c11%'"


@query(f"select id, name, rank from ({_LIKE_SQL}) order by rank, length(name), id limit 100")
def search_like(g):
    return search.like_ranked(g.nodes, "C11").select("id", "name", "rank")


@query(_BM25_SQL + """, one as (select row_number() over (order by round(score, 4), (name = 'ship r1') desc, kind, id) as pos, id from sc join nodes using (id) qualify pos <= 100),
 two as (select row_number() over (order by length(name), id) + 100 as pos, id from nodes where lower(id) like '%ship r1%' qualify pos <= 200),
 b as (select id, min(pos) as pos from (select * from one union all select * from two) group by id) select cast(row_number() over (order by pos) as int) as pos, id from b""")
def search_combined(g):
    return search.combined(g.nodes, "ship r1", index=g.postings, totals=g.totals())


@query("select path, line, text from (select path, unnest(range(1, len(l) + 1))::int as line, unnest(l) as text from (select path, string_split(text, chr(10)) as l from files)) where contains(lower(text), 'license') order by path, line limit 300")
def grep_lines(g):
    return inventory.grep(g.files.select("path", "text"), "LICENSE")


@query("select path, cast(2 as int) as start_line, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) as text from files")
def method_slice(g):
    texts = g.files
    return inventory.sliced(texts.select("path", "text"), texts.select("path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line")))


@query("select id, rpad(kind, 10, ' ') || ' ' || id || ' [' || file_path || ':' || start_line || ']' || coalesce(' [entry:' || entry_kind || ']', '') as line from nodes")
def node_format(g):
    return g.nodes.select("id", names.rendered(F.col("kind"), F.col("id"), F.col("file_path"), F.col("start_line"), F.col("entry_kind")).alias("line"))


# --- index time

_PATHS = "select p_partkey, 'a/P'||p_partkey||case p_partkey%9 when 0 then '.JAR' when 1 then '.war' when 2 then '.ear' when 3 then '.jmod' when 4 then '.class' when 5 then '.Java' when 6 then '.md' when 7 then 'jar' else '.jar/x' end as path from part"


@query(f"select path, case when regexp_matches(lower(path), '\\.(jar|war|ear|jmod)$') then 'archive' when lower(path) like '%.class' then 'class' when lower(path) like '%.java' then 'java' end as route from ({_PATHS}) v")
def file_routing(g):
    return g.sql(_PATHS).select("path", inventory.route(F.col("path")).alias("route"))


@query("select text as internal, container, seq from (select text, container, seq, row_number() over (partition by text order by seq) as k from files) where k = 1")
def dedup_first_wins(g):
    return merge.first_rows(g.files.withColumnRenamed("text", "internal"), "internal", ["container", "seq"])


@query("select distinct container from files")
def dedup_paths(g):
    return g.files.select("container").dropDuplicates(["container"])


@query("select md5(text) as internal, kept, container as other, seq from (select text, container, seq, first_value(container) over (partition by text order by seq) as kept, row_number() over (partition by text order by seq) as k from files) where k > 1")
def duplicate_report(g):
    return merge.duplicates(g.files.withColumn("internal", F.md5("text")), "internal", "container").select("internal", "kept", "other", "seq")


_TWICE = """select id, kind, name, owner, descriptor, cast(null as string) as file_path, 0 as start_line, 0 as end_line, entry_kind, 0 as synthetic, 0 as seq from nodes
 union all select id, 'again', upper(name), owner, descriptor, file_path, start_line, end_line, cast(null as string), synthetic, 1 from nodes
 union all select id, 'late', name, 'elsewhere', descriptor, '/late', -1, 0, entry_kind, 0, 2 from nodes"""


@query("select id, kind, name, coalesce(owner, 'elsewhere') as owner, descriptor, file_path, start_line, end_line, entry_kind, synthetic from nodes")
def node_merge(g):
    g.nodes.createOrReplaceTempView("nodes")
    return merge.merge_nodes(g.spark.sql(_TWICE))


@query("select source, target, kind, 0 as line, 'bytecode' as origin, 'first' as provenance from edges")
def edge_dedup(g):
    first = g.edges.select("*", F.lit(0).alias("line"), F.lit("bytecode").alias("origin"), F.lit("first").alias("provenance"), F.lit(0).alias("seq"))
    again = g.edges.select("*", F.lit(7).alias("line"), F.lit("source").alias("origin"), F.lit("later").alias("provenance"), F.lit(1).alias("seq"))
    return merge.first_edges(again.unionByName(first))


@query("select container, path, size, seq from (select *, row_number() over (partition by container order by seq desc) as k from files) where k = 1")
def file_upsert(g):
    return merge.last_rows(g.files, "container", ["path", "size", "seq"])


@query("select container as key, path as value from (select *, row_number() over (partition by container order by seq desc) as k from files) where k = 1")
def meta_upsert(g):
    return merge.last_rows(g.files.select(F.col("container").alias("key"), F.col("path").alias("value"), "seq"), "key", ["value"])


@query("""select e.source, case when u.descriptor is not null then 'M:' || e.owner || '#' || e.name || u.descriptor else 'M:' || e.owner || '#' || e.name || '(' || repeat('L?;', e.n) || ')?' end as target, 'calls' as kind,
 case when u.descriptor is not null then 'source-resolved' else 'source-static-best-effort' end as provenance
 from (select source, split_part(substr(target, 3), '#', 1) as owner, split_part(split_part(substr(target, 3), '#', 2), '(', 1) as name, case when target like '%(I)V' or target like '%String;)I' then 1 else 0 end as n from calls) e
 left join (select owner, name, n, min(descriptor) as descriptor from (select distinct owner, name, descriptor, case when descriptor = '()V' then 0 else 1 end as n from mth) group by 1, 2, 3 having count(*) = 1) u on u.owner = e.owner and u.name = e.name and u.n = e.n""")
def link_calls(g):
    p = names.method_parts(F.col("target"))
    holes = F.concat(F.lit("("), F.repeat(F.lit("L?;"), names.arity(p["descriptor"])), F.lit(")?"))
    open_calls = g.calls.select("source", names.method_id(p["owner"], p["name"], holes).alias("target"), F.lit("calls").alias("kind"), F.lit("source-static-best-effort").alias("provenance"))
    return merge.link_calls(open_calls, g.mth)


@query("""select caller_owner, scope, name, n, case when coalesce(scope, 'this') = 'this' and name = 'bill' then 'M:' || caller_owner || '#bill()V' when scope = 'Brand' then 'M:lib/Brand#' || name || '(' || repeat('L?;', n) || ')?'
  when scope = 'Math' then 'M:java/lang/Math#' || name || '(' || repeat('L?;', n) || ')?' when scope = 'Other' then 'M:app/cust/Other#' || name || '(' || repeat('L?;', n) || ')?' else 'M:?#' || name || '(' || repeat('L?;', n) || ')?' end as target,
 case when coalesce(scope, 'this') = 'this' and name = 'bill' then 'source-self' when scope = 'Brand' then 'source-static-import' when scope in ('Other', 'Math') then 'source-static-best-effort' when scope = 'super' then 'source-super-unresolved' else 'source-unresolved' end as provenance,
 case when (coalesce(scope, 'this') = 'this' and name = 'bill') or scope in ('Brand', 'Other', 'Math') then 'calls' else 'references' end as kind
 from (select 'app/cust/C' || c_custkey as caller_owner, case c_custkey % 7 when 0 then 'this' when 1 then 'Brand' when 2 then 'Other' when 3 then 'super' when 4 then 'Math' when 5 then null else 'x' end as scope, case when c_custkey % 3 = 0 then 'bill' else 'send' end as name, case when c_custkey % 3 = 0 then 0 else 2 end as n from customer)""")
def call_resolution_ladder(g):
    k = F.col("c_custkey")
    found = g.customer.select(
        F.concat(F.lit("app/cust/C"), k.cast("string")).alias("caller_owner"),
        F.when(k % 7 == 0, "this").when(k % 7 == 1, "Brand").when(k % 7 == 2, "Other").when(k % 7 == 3, "super").when(k % 7 == 4, "Math").when(k % 7 == 5, None).otherwise("x").alias("scope"),
        F.when(k % 3 == 0, "bill").otherwise("send").alias("name"),
        F.when(k % 3 == 0, 0).otherwise(2).alias("n"),
    )
    imports = found.select("caller_owner", F.lit("Brand").alias("simple"), F.lit("lib/Brand").alias("internal")).distinct()
    return merge.resolve_source_calls(found, g.mth, imports)


_LANG = "'Object', 'String', 'Integer', 'Long', 'Short', 'Byte', 'Boolean', 'Character', 'Float', 'Double', 'Number', 'Void', 'Throwable', 'Exception', 'RuntimeException', 'Error', 'Class', 'Enum', 'Iterable', 'Comparable', 'CharSequence', 'StringBuilder', 'StringBuffer', 'System', 'Math', 'Thread', 'Runnable'"
#: A written type for each part: the language's own by turns, type variables, imports, dotted, generic and plain names.
_WRITTEN = f"""select p_partkey, case p_partkey%8 when 0 then l.word when 1 then l.word||'<T>' when 2 then upper(substr(p_name,1,1)) when 3 then 'List<'||l.word||'>' when 4 then 'a.b.P'||p_partkey when 5 then 'Map.Entry<K, V>' when 6 then ' P'||p_partkey||' <K, List<V>> ' else case when p_partkey%16=7 then 'Process' else '' end end as written
 from part left join (select word, row_number() over (order by word) - 1 as k from (values ('Object'), ('String'), ('Integer'), ('Long'), ('Short'), ('Byte'), ('Boolean'), ('Character'), ('Float'), ('Double'), ('Number'), ('Void'), ('Throwable'), ('Exception'), ('RuntimeException'), ('Error'), ('Class'), ('Enum'), ('Iterable'), ('Comparable'), ('CharSequence'), ('StringBuilder'), ('StringBuffer'), ('System'), ('Math'), ('Thread'), ('Runnable'), ('ClassLoader'), ('Override')) w(word)) l on l.k = p_partkey%29"""


@query(f"""select p_partkey, written, case when plain = '' then 'java/lang/Object' when contains(plain, '.') then replace(plain, '.', '/') when plain = 'List' then 'java/util/List' when plain in ({_LANG}) then 'java/lang/' || plain
  when regexp_full_match(plain, '[A-Z]') then 'java/lang/Object' else 'p/q/' || plain end as internal from (select *, trim(split_part(written, '<', 1)) as plain from ({_WRITTEN}) w) q""")
def resolve_type_name(g):
    imports = F.create_map(F.lit("List"), F.lit("java/util/List"))
    return g.sql(_WRITTEN).select("p_partkey", "written", names.internal_name(F.col("written"), imports, F.lit("p/q")).alias("internal"))


#: A descriptor for each order, with the number of its parameters.
_DESCRIBED = """select o_orderkey, case o_orderkey%6 when 0 then '('||repeat('I',cast(o_custkey%5 as int))||')V' when 1 then '('||repeat('[[J',cast(o_custkey%5 as int))||repeat('Ljava/lang/String;',2)||'[La/B;)V' when 2 then '('||repeat('L?;',cast(o_custkey%5 as int))||')?'
 when 3 then '(Lbroken' when 4 then '(Q)V' else 'V' end as descriptor, cast(case o_orderkey%6 when 0 then o_custkey%5 when 1 then o_custkey%5+3 when 2 then o_custkey%5 else 0 end as int) as n from orders"""


@query(f"select o_orderkey, descriptor, n from ({_DESCRIBED}) q")
def descriptor_arity(g):
    return g.sql(_DESCRIBED).select("o_orderkey", "descriptor", names.arity(F.col("descriptor")).alias("n"))


_MEMBERS = """select o_orderkey, case o_custkey%3 when 0 then 'field' when 1 then 'method' else 'class' end as kind, case o_orderkey%5 when 0 then 'val$x' when 1 then 'this$0' when 2 then 'access$000' else 'm' end as name, cast(case o_orderkey%7 when 0 then 4096 when 1 then 64 when 2 then 4160 when 3 then 9 else 1 end as int) as access from orders"""


@query(f"""select *, cast(case when access in (64, 4096, 4160) then 1 when kind = 'field' and (name like 'val$%' or name like 'this$%') then 1 when kind = 'method' and name like 'access$%' then 1 else 0 end as int) as synthetic from ({_MEMBERS}) q""")
def synthetic_flags(g):
    return g.sql(_MEMBERS).withColumn("synthetic", names.is_synthetic(F.col("kind"), F.col("name"), F.col("access")))


@query("""select m.id, '/mirror/' || m.owner || '.java' as file_path, cast(length(m.name) as int) as start_line from nodes m where m.kind = 'method' and m.name <> 'get'
 union all select m.id, null, null from nodes m where m.kind = 'method' and m.name = 'get'""")
def enrich_positions(g):
    methods = g.nodes.where("kind = 'method'").select("id", "owner", "name", "descriptor")
    at = methods.where("name <> 'get'").select("owner", "name", F.when(F.col("name") == "ship", "(Lx/Unknown;)V").otherwise(F.col("descriptor")).alias("descriptor"), F.concat(F.lit("/mirror/"), "owner", F.lit(".java")).alias("file_path"), F.length("name").alias("start_line"))
    return merge.enrich_positions(methods, at)


# --- inventory

_HASHED = "select *, sha256(text) as content_hash from files"
_STORED = f"select path, content_hash from ({_HASHED}) where seq % 11 <> 0"
_CURRENT = "select path, sha256(case when seq % 17 = 0 then text || '!' else text end) as content_hash from files where seq % 13 <> 0"


def _stored_and_current(g) -> tuple[DataFrame, DataFrame]:
    stored = g.files.where("seq % 11 <> 0").select("path", F.sha2("text", 256).alias("content_hash"))
    current = g.files.where("seq % 13 <> 0").select("path", F.sha2(F.when(F.col("seq") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return stored, current


@query("select (select count(*) from nodes) as nodes, (select count(*) from nodes where kind = 'method') as methods, cast(0 as bigint) as fields, (select count(*) from edges) as edges, (select count(*) from calls) as calls, (select count(*) from cls) as classes")
def overview_counts(g):
    return inventory.overview(g.nodes, g.edges)


@query("select path, origin, container, language, size from files order by language nulls first, path limit 300")
def files_list(g):
    return inventory.listed(g.files).select("path", "origin", "container", "language", "size")


@query("select coalesce(origin, '') as key, count(*) as n from files group by 1")
def files_by_origin(g):
    return inventory.counts_by(g.files, "origin")


@query("select coalesce(language, '') as key, count(*) as n from files group by 1")
def files_by_language(g):
    return inventory.counts_by(g.files, "language")


@query("select path, sha256(text) as content_hash, octet_length(encode(text)) as bytes from files")
def file_hash(g):
    return g.files.select("path", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"select s.path, case when c.path is null then 'missing' else 'changed' end as errors from ({_STORED}) s left join ({_CURRENT}) c on c.path = s.path where c.path is null or c.content_hash <> s.content_hash")
def files_changed(g):
    return inventory.changed(*_stored_and_current(g))


@query(f"select path from ({_CURRENT}) where path not in (select path from ({_STORED}))")
def files_added(g):
    return inventory.added(*_stored_and_current(g))


@query(f"""select count(*) filter (where c.path is not null and s.path is not null and c.content_hash <> s.content_hash) as n_changed, count(*) filter (where c.path is null) as n_missing,
 count(*) filter (where s.path is null) as n_added, count(*) filter (where c.path is null or s.path is null or c.content_hash <> s.content_hash) > 0 as stale from ({_STORED}) s full join ({_CURRENT}) c on c.path = s.path""")
def staleness(g):
    return inventory.is_stale(*_stored_and_current(g))


