"""A code graph derived from the star-schema tables, for queries that must run on any scale factor.

Regions are interfaces, nations implement them, suppliers and customers extend their nation, parts are
library classes, orders are methods of their customer.  The same text defines the base tables in Spark and in
DuckDB; closure, overrides and reverse steps are computed by the operators here and by recursion there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph, search, security
from .lineage import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

CLS = """
select 'geo/R'||r_regionkey as internal,'interface' as kind,'R'||r_regionkey as name,cast(null as string) as sup,cast(null as string) as itf from region
 union all select 'geo/R'||n_regionkey||'/N'||n_nationkey,'class','N'||n_nationkey,null,'geo/R'||n_regionkey from nation
 union all select 'app/sup/S'||s_suppkey,'class','S'||s_suppkey,'geo/R'||n_regionkey||'/N'||n_nationkey,null from supplier join nation on s_nationkey=n_nationkey
 union all select 'app/cust/C'||c_custkey,'class','C'||c_custkey,'geo/R'||n_regionkey||'/N'||n_nationkey,null from customer join nation on c_nationkey=n_nationkey
 union all select 'lib/'||replace(p_brand,'#','')||'/P'||p_partkey,case when p_size%10=0 then 'enum' else 'class' end,'P'||p_partkey,null,null from part"""
#: A few methods are static (8) or private (2).
MTH = """
select *,case length(owner)%7 when 0 then 8 when 1 then 2 else 1 end as access from (
select internal as owner,'ship' as name,'(I)V' as descriptor,cast(null as string) as entry_kind,0 as synthetic from cls where internal like 'geo/%' or internal like 'app/sup/%'
 union all select internal,'bill','()V',null,0 from cls where internal like 'geo/R%/N%' or internal like 'app/cust/%'
 union all select internal,'get','(Ljava/lang/String;)I',null,0 from cls where internal like 'lib/%'
 union all select 'app/cust/C'||o_custkey,'o'||o_orderkey,'()V',case substring(o_orderpriority,1,1) when '1' then 'HTTP' when '2' then 'SERVLET' when '3' then 'MQ' when '4' then 'ASYNC' end,case when o_orderkey%10=0 then 1 else 0 end from orders) q"""
CALLS = """
select distinct 'M:app/cust/C'||o_custkey||'#o'||o_orderkey||'()V' as source,'M:lib/'||replace(p_brand,'#','')||'/P'||p_partkey||'#get(Ljava/lang/String;)I' as target from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey where l_linenumber=1
 union select 'M:lib/'||replace(a.p_brand,'#','')||'/P'||a.p_partkey||'#get(Ljava/lang/String;)I','M:lib/'||replace(b.p_brand,'#','')||'/P'||b.p_partkey||'#get(Ljava/lang/String;)I' from part a join part b on b.p_partkey=(a.p_partkey*31+7)%(select count(*) from part)
 union select 'M:lib/'||replace(p_brand,'#','')||'/P'||p_partkey||'#get(Ljava/lang/String;)I',case when p_partkey%10=0 then 'M:geo/R'||n_regionkey||'/N'||n_nationkey||'#ship(I)V' else 'M:app/sup/S'||s_suppkey||'#ship(I)V' end from part join supplier on s_suppkey=p_partkey%(select count(*) from supplier) join nation on s_nationkey=n_nationkey where p_partkey%5=0
 union select 'M:app/sup/S'||s_suppkey||'#ship(I)V','M:geo/R'||n_regionkey||'/N'||n_nationkey||'#bill()V' from supplier join nation on s_nationkey=n_nationkey"""
RULES = """
select kind,category,owner,name,cast(row_number() over (order by kind,owner,name) as int) as seq from (
 select 'sink' as kind,lower(p_type) as category,'lib/'||replace(p_brand,'#','')||'/P'||p_partkey as owner,'get' as name from part where p_partkey%50=0
 union all select 'sink','dispatch','geo/R'||n_regionkey||'/N'||n_nationkey,'ship' from nation where n_nationkey%5=0
 union all select 'source','intake','app/sup/S'||s_suppkey,'ship' from supplier where s_suppkey%7=0) q"""
NODES = """
select 'C:'||internal as id,kind,name,cast(null as string) as owner,cast(null as string) as descriptor,'/src/'||internal||'.java' as file_path,cast(length(internal)%40+1 as int) as start_line,cast(length(internal)%40+9 as int) as end_line,cast(null as string) as entry_kind,0 as synthetic from cls
 union all select 'M:'||owner||'#'||name||descriptor,'method',name,owner,descriptor,'/src/'||owner||'.java',cast(length(owner)%40+3 as int),cast(length(owner)%40+5 as int),entry_kind,synthetic from mth"""
EDGES = """
select 'C:'||owner as source,'M:'||owner||'#'||name||descriptor as target,'contains' as kind from mth
 union all select 'C:'||internal,'C:'||sup,'extends' from cls where sup is not null
 union all select 'C:'||internal,'C:'||itf,'implements' from cls where itf is not null
 union all select source,target,'calls' from calls"""
FILES = """
select source||'/'||doc_id||'.java' as path,case doc_id%3 when 0 then 'bytecode' when 1 then 'source' else 'decompiled' end as origin,source as container,lang as language,n_chars as size,text,doc_id as seq from documents"""
BASE = {"cls": CLS, "mth": MTH, "calls": CALLS, "rules": RULES, "nodes": NODES, "edges": EDGES, "files": FILES}

#: Oracle forms only; the engine computes these itself.
DERIVED = {
    "up": "select internal as t, sup as a from cls where sup is not null union all select internal,itf from cls where itf is not null",
    "cl": "select t,a from up union all select cl.t,up.a from cl join up on up.t=cl.a",
    "anc": "select distinct t,a from cl",
    "ovr": "select 'M:'||s.owner||'#'||s.name||s.descriptor as source,'M:'||p.owner||'#'||p.name||p.descriptor as target from anc join mth s on s.owner=anc.t join mth p on p.owner=anc.a and p.name=s.name and p.descriptor=s.descriptor where s.access not in (2,8)",
    "rev": "select m,caller,min(rk) as rk from (select target as m,source as caller,0 as rk from calls union all select o.source,c.source,1 from ovr o join calls c on c.target=o.target) q group by m,caller",
    "srcm": "select distinct c.source as m from calls c join rules r on r.kind='source' and split_part(c.target,'(',1)='M:'||r.owner||'#'||r.name",
    "sites": "select distinct r.*, c.source, c.target from calls c join rules r on lower(split_part(c.target,'(',1))=lower('M:'||r.owner||'#'||r.name)",
}


def oracle(query: str) -> str:
    """The query with all fixture tables before it."""
    return "with recursive " + ",\n".join(f"{n} as ({q})" for n, q in (BASE | DERIVED).items()) + "\n" + query


#: Frames that an index would store: written once for a session and folder, then read.
STORED = ("cls", "mth", "calls", "rules", "nodes", "edges", "closure", "overrides", "sites", "source_methods", "postings")


class Fixture:
    """The fixture's frames for one folder of tables, each built when first asked for."""

    _shared: dict[tuple[str, str], Fixture] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Fixture:
        """The session's fixture of a folder, with what is stored of it already."""
        return cls._shared.setdefault((spark.sparkContext.applicationId, sf_dir), cls(spark, sf_dir))

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = cut(self._make(name)) if name in STORED else self._make(name)
        return self._made[name]

    def totals(self) -> tuple[int, int]:
        """Rows and tokens of the search index."""
        return self.nodes.count(), self.postings.count()

    def sql(self, text: str) -> DataFrame:
        """A query that both engines read, over the tables and base frames it names."""
        for t in (*TABLES, *BASE):
            if f" {t}" in text:
                getattr(self, t).createOrReplaceTempView(t)  # resolved at once, so the name is free again
        return self.spark.sql(text)

    def _make(self, name: str) -> DataFrame | graph.Reverse:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in BASE:
            return self.sql(BASE[name])
        if name == "supers":
            up = self.cls
            return up.where("sup is not null").selectExpr("internal as t", "sup as a").unionByName(up.where("itf is not null").selectExpr("internal as t", "itf as a"))
        if name == "closure":
            return graph.ancestor_closure(self.supers)
        if name == "overrides":
            return graph.override_edges(self.closure, self.mth)
        if name == "reverse":
            return graph.Reverse(self.calls, self.overrides)
        if name == "sites":
            return security.call_sites(self.calls, self.rules)
        if name == "postings":
            return search.indexed(self.nodes).repartitionByRange("token").sortWithinPartitions("token")
        if name == "source_methods":
            return security.source_methods(self.sites)
        raise AttributeError(name)
