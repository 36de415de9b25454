"""The fact-graph tables as views over the given business tables.

Customers, suppliers, parts and places become entities; orders and order lines become facts;
documents and events become records; conversations become messages and model calls. Every view is a
projection (at most a key join) of the given tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import small_table, spread


# Declared, so that opening a table needs no job to look into its files.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def line_edge() -> Column:
    """Edge id of an order line; two lines may share all keys, so price and shipping day are part of it."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    return F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, day)


class Tables:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        zoned = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoned}) if zoned else df

    # -- entities ------------------------------------------------------------------------------

    def entities(self) -> DataFrame:
        none = F.lit(None).cast("string")
        born = F.lit("1992-01-01").cast("timestamp")

        def view(table, kind, key, name, email=none, domain=none, **bag):
            pairs = [x for k, v in bag.items() for x in (F.lit(k), F.col(v).cast("string"))]
            return self.raw(table).select(
                F.concat(F.lit(f"{kind}:"), F.col(key)).alias("entity_id"),
                F.lit(kind).alias("entity_type"),
                F.col(name).alias("name"),
                email.alias("email"),
                domain.alias("domain"),
                F.create_map(*pairs).alias("metadata"),
                born.alias("created_at"),
            )

        people = view(
            "customer",
            "person",
            "c_custkey",
            "c_name",
            email=F.concat(F.lower("c_name"), F.lit("@n"), "c_nationkey", F.lit(".example")),
            role="c_mktsegment",
        )
        companies = view(
            "supplier",
            "company",
            "s_suppkey",
            "s_name",
            domain=F.concat(F.lit("n"), "s_nationkey", F.lit(".example")),
            balance="s_acctbal",
        )
        projects = view("part", "project", "p_partkey", "p_name", brand="p_brand")
        nations = view("nation", "nation", "n_nationkey", "n_name", region="n_regionkey")
        regions = view("region", "region", "r_regionkey", "r_name", code="r_regionkey")
        return (
            people.unionByName(companies)
            .unionByName(projects)
            .unionByName(nations)
            .unionByName(regions)
        )

    def aliases(self) -> DataFrame:
        """Surface forms: a short form per person, company and project (some are shared)."""
        e = self.entities().filter(F.col("entity_type").isin("person", "company", "project"))
        number = F.split_part("entity_id", F.lit(":"), F.lit(2)).cast("long")
        short = (
            F.when(F.col("entity_type") == "person", F.concat(F.lit("Cust "), number % 400))
            .when(F.col("entity_type") == "company", F.concat(F.lit("Supp "), number))
            .otherwise(F.concat("name", F.lit(" "), number % 900))
        )
        at = F.lit("2000-01-01").cast("timestamp")
        return e.select(
            "entity_id",
            short.alias("surface_form"),
            F.when(number % 2 == 0, "stated").otherwise("inferred").alias("confidence"),
            F.concat(F.lit("order_"), number).alias("source_record"),
            F.lit("order").alias("source_type"),
            F.lit("").alias("reasoning"),
            at.alias("resolved_at"),
            at.alias("created_at"),
        )

    # -- facts ---------------------------------------------------------------------------------

    def _fact(
        self,
        source: DataFrame,
        edge_id: Column,
        from_id: Column,
        label: str,
        kind: str,
        fact: Column,
        source_at: Column,
        to_id: Column | None = None,
        to_day: Column | None = None,
        confidence: Column | None = None,
        source_record: Column | None = None,
        source_type: str = "order",
        delay_days: Column | None = None,
        valid_until: Column | None = None,
        op_area: str = "reality",
    ) -> DataFrame:
        def text(value):
            return (F.lit(None) if value is None else value).cast("string")

        def day(value):
            return (F.lit(None) if value is None else value).cast("date")

        wait = F.lit(0) if delay_days is None else delay_days.cast("int")
        return source.select(
            edge_id.alias("edge_id"),
            from_id.alias("from_id"),
            text(to_id).alias("to_id"),
            day(to_day).alias("to_day"),
            F.lit(label).alias("edge_label"),
            F.lit(kind).alias("fact_type"),
            fact.alias("fact"),
            (F.lit("stated") if confidence is None else confidence).alias("confidence"),
            (F.lit("seed") if source_record is None else source_record).alias("source_record"),
            F.lit(source_type).alias("source_type"),
            source_at.alias("source_at"),
            (source_at + F.make_interval(days=wait)).alias("recorded_at"),
            F.lit(False).alias("stale"),
            text(None).alias("replaced_by"),
            day(valid_until).alias("valid_until"),
            F.lit(op_area).alias("op_area"),
        )

    def _order_ref(self, key: str) -> Column:
        return F.concat(F.lit("order_"), F.col(key))

    def commitments(self) -> DataFrame:
        o = self.raw("orders")
        return self._fact(
            o,
            F.concat(F.lit("c:"), "o_orderkey"),
            F.concat(F.lit("person:"), "o_custkey"),
            "ASSERTED",
            "commitment",
            F.col("o_orderpriority"),
            F.col("o_orderdate"),
            to_day=F.to_date("o_orderdate"),
            confidence=F.when(F.col("o_orderkey") % 3 == 0, "inferred").otherwise("stated"),
            source_record=self._order_ref("o_orderkey"),
            delay_days=F.col("o_orderkey") % 5,
            valid_until=F.date_add(F.to_date("o_orderdate"), 30),
            op_area="intention",
        )

    def completions(self) -> DataFrame:
        o = self.raw("orders").filter("o_orderstatus = 'F'")
        return self._fact(
            o,
            F.concat(F.lit("t:"), "o_orderkey"),
            F.concat(F.lit("person:"), "o_custkey"),
            "TRANSITIONED",
            "completion",
            F.concat(F.lit("order "), "o_orderkey", F.lit(" completed")),
            F.col("o_orderdate"),
            to_day=F.to_date("o_orderdate"),
            source_record=self._order_ref("o_orderkey"),
            delay_days=F.col("o_orderkey") % 7,
        )

    def contributions(self) -> DataFrame:
        li = self.raw("lineitem")
        return self._fact(
            li,
            line_edge(),
            F.concat(F.lit("company:"), "l_suppkey"),
            "AFFILIATED",
            "contributor",
            F.concat(F.lit("contributes "), "l_linestatus", "l_returnflag"),
            F.col("l_shipdate"),
            to_id=F.concat(F.lit("project:"), "l_partkey"),
            confidence=F.when(F.col("l_returnflag") == "R", "inferred").otherwise("stated"),
            source_record=self._order_ref("l_orderkey"),
            delay_days=F.col("l_linenumber"),
        )

    def geography(self) -> DataFrame:
        seeded = F.lit("1992-01-01").cast("timestamp")

        def link(table, prefix, kind, key, fact_type, to_kind, to_key):
            return self._fact(
                self.raw(table),
                F.concat(F.lit(prefix), key),
                F.concat(F.lit(f"{kind}:"), key),
                "AFFILIATED",
                fact_type,
                F.lit(f"{fact_type} of {to_kind}"),
                seeded,
                to_id=F.concat(F.lit(f"{to_kind}:"), to_key),
                source_type="ingest",
            )

        return (
            link("customer", "k:", "person", "c_custkey", "stakeholder", "nation", "c_nationkey")
            .unionByName(
                link("supplier", "s:", "company", "s_suppkey", "subsidiary", "nation", "s_nationkey")
            )
            .unionByName(
                link("nation", "n:", "nation", "n_nationkey", "sub_project", "region", "n_regionkey")
            )
        )

    def facts(self) -> DataFrame:
        return (
            self.commitments()
            .unionByName(self.completions())
            .unionByName(self.contributions())
            .unionByName(self.geography())
        )

    def case_facts(self) -> DataFrame:
        """Blockers (open orders of one status), resolutions and references per customer."""
        o = self.raw("orders")
        person = F.concat(F.lit("person:"), "o_custkey")
        record = self._order_ref("o_orderkey")

        def view(rows, prefix, label, kind):
            return self._fact(
                rows,
                F.concat(F.lit(prefix), "o_orderkey"),
                person,
                label,
                kind,
                F.concat(F.lit(f"{kind} on order "), "o_orderkey"),
                F.col("o_orderdate"),
                to_day=F.to_date("o_orderdate"),
                source_record=record,
            )

        return (
            view(o.filter("o_orderstatus = 'P'"), "b:", "ASSERTED", "blocker")
            .unionByName(
                view(
                    o.filter("o_orderstatus = 'O' AND o_orderkey % 10 = 0"),
                    "r:",
                    "TRANSITIONED",
                    "resolution",
                )
            )
            .unionByName(
                view(
                    o.filter("o_orderstatus = 'O' AND o_orderkey % 10 = 1"),
                    "f:",
                    "ASSERTED",
                    "reference",
                )
            )
        )

    def fact_sources(self) -> DataFrame:
        """The order behind every order-line fact, and a second order for part of them."""
        li = self.raw("lineitem")
        edge = line_edge()
        own = li.select(
            edge.alias("edge_id"),
            self._order_ref("l_orderkey").alias("record_id"),
            F.when(F.col("l_returnflag") == "R", "inferred").otherwise("stated").alias("confidence"),
        )
        second = li.filter("l_partkey % 4 = 0").select(
            edge.alias("edge_id"),
            F.concat(F.lit("order_"), F.col("l_orderkey") + 1).alias("record_id"),
            F.when(F.col("l_partkey") % 8 == 0, "stated").otherwise("inferred").alias("confidence"),
        )
        return own.unionByName(second)

    # -- records -------------------------------------------------------------------------------

    def records(self) -> DataFrame:
        none = F.lit(None).cast("string")
        docs = self.raw("documents").select(
            F.concat(F.lit("document_"), "doc_id").alias("record_id"),
            F.lit("document").alias("type"),
            F.col("source"),
            F.lit("2024-01-01").cast("timestamp").alias("created_at"),
            F.col("text").alias("content"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
            F.md5("text").alias("dedup_key"),
            F.lit("documents").alias("expert_name"),
            F.lit("0.1.0").alias("expert_version"),
            (F.col("doc_id") % 3 == 0).alias("indexed"),
            F.when(F.col("doc_id") % 5 == 0, "noise")
            .when(F.col("doc_id") % 5 != 1, "relevant")
            .alias("classification"),
            F.col("text").alias("raw"),
            F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("written in "), "lang")).alias("human_context"),
        )
        events = self.raw("events").select(
            F.concat(F.lit("event_"), "event_id").alias("record_id"),
            F.col("event_type").alias("type"),
            F.concat(F.lit("user_"), "user_id").alias("source"),
            F.col("ts").alias("created_at"),
            F.lit("").alias("content"),
            F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"),
            none.alias("dedup_key"),
            F.lit("events").alias("expert_name"),
            F.lit("0.2.0").alias("expert_version"),
            F.lit(False).alias("indexed"),
            F.when(F.col("event_type") == "error", "noise")
            .otherwise("relevant")
            .alias("classification"),
            F.col("props").alias("raw"),
            none.alias("human_context"),
        )
        return docs.unionByName(events)

    def mail(self) -> DataFrame:
        """Mail payloads: one per conversation turn, between two customers."""
        conv = self.raw("conversations")
        people = self.raw("customer").select("c_custkey", "c_name", "c_nationkey")

        def address(name: str, nation: str) -> Column:
            return F.concat(F.lower(name), F.lit("@n"), nation, F.lit(".example"))

        sender = people.toDF("_s", "_s_name", "_s_nation")
        reader = people.toDF("_r", "_r_name", "_r_nation")
        pick = F.col("conv_id") * 31 + F.col("turn") * 7
        n = people.agg(F.max("c_custkey") + 1).scalar()
        joined = (
            conv.withColumn("_s", pick % n)
            .withColumn("_r", (pick + 11) % n)
            .join(sender, "_s")
            .join(reader, "_r")
        )
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
        header = F.when(
            F.col("turn") % 7 == 5,
            F.array(
                F.struct(F.lit("Precedence").alias("name"), F.lit("bulk").alias("value")),
            ),
        ).when(
            F.col("turn") % 7 == 6,
            F.array(
                F.struct(F.lit("Auto-Submitted").alias("name"), F.lit("No").alias("value")),
            ),
        )
        return joined.select(
            F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("message_id"),
            F.concat(F.lit("ses_"), "conv_id").alias("thread_id"),
            F.when(pick % 13 == 5, F.lit("No-Reply@shop.example"))
            .otherwise(address("_s_name", "_s_nation"))
            .alias("sender"),
            F.concat("_r_name", F.lit(" <"), address("_r_name", "_r_nation"), F.lit(">")).alias(
                "recipients"
            ),
            F.left(F.translate("text", "\n", " "), F.lit(40)).alias("subject"),
            F.col("text").alias("body"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("received_at"),
            header.alias("headers"),
        )

    def issue_nodes(self) -> DataFrame:
        """Issues in the nested shape of an issue tracker's API, one per document."""
        d = self.raw("documents")
        stamp = F.date_format(
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        )

        def named(value: Column) -> Column:
            return F.struct(value.alias("name"))

        def comment(body: Column, author: Column) -> Column:
            return F.struct(
                body.alias("body"), named(author).alias("user"), stamp.alias("createdAt")
            )

        state = F.element_at(
            F.array(*[F.lit(s) for s in ("Todo", "In Progress", "Done", "Canceled")]),
            (F.col("doc_id") % 4 + 1).cast("int"),
        )
        return d.select(
            F.concat(F.lit("iss_"), "doc_id").alias("id"),
            F.concat(F.upper("lang"), F.lit("-"), "doc_id").alias("identifier"),
            F.left(F.translate("text", "\n", " "), F.lit(60)).alias("title"),
            F.when(F.col("doc_id") % 6 != 0, F.col("text")).alias("description"),
            named(state).alias("state"),
            (F.col("doc_id") % 5).cast("int").alias("priority"),
            F.concat(F.lit("P"), F.col("doc_id") % 5).alias("priorityLabel"),
            F.when(
                F.col("doc_id") % 3 != 0,
                F.struct(
                    F.concat(F.lit("user "), F.col("doc_id") % 17).alias("name"),
                    F.concat(F.lit("u"), F.col("doc_id") % 17, F.lit("@x.example")).alias("email"),
                ),
            ).alias("assignee"),
            named(F.col("source")).alias("project"),
            F.struct(F.array(named(F.col("lang")), named(F.col("source"))).alias("nodes")).alias(
                "labels"
            ),
            F.struct(
                F.when(
                    F.col("doc_id") % 4 == 1,
                    F.array(
                        comment(F.col("text"), F.col("source")),
                        comment(F.lit(""), F.lit("nobody")),
                        comment(F.left("text", F.lit(20)), F.lit(None).cast("string")),
                    ),
                ).alias("nodes")
            ).alias("comments"),
            F.concat(F.lit("https://issues.example/"), "doc_id").alias("url"),
            stamp.alias("createdAt"),
            stamp.alias("updatedAt"),
        )

    def history_nodes(self) -> DataFrame:
        """Issue history in nested API shape, one node per event."""
        e = self.raw("events").withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
        issues = self.raw("documents").agg(F.count(F.lit(1))).scalar()

        def named(value) -> Column:
            return F.struct(value.alias("name"))

        no_name = F.struct(F.lit(None).cast("string").alias("name"))
        moved = F.col("event_type").isin("purchase", "signup")
        return e.select(
            F.concat(F.lit("iss_"), F.col("event_id") % issues).alias("issue_id"),
            F.concat(F.lit("h"), "event_id").alias("id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
            F.when(F.col("user_id") % 10 != 0, named(F.concat(F.lit("user_"), "user_id"))).alias(
                "actor"
            ),
            F.when(moved & (F.col("_k") > 50), named(F.lit("Todo"))).alias("fromState"),
            F.when(moved, named(F.initcap("event_type"))).alias("toState"),
            F.when(F.col("event_type") == "view", no_name).alias("fromAssignee"),
            F.when(
                F.col("event_type").isin("view", "click"),
                named(F.concat(F.lit("user "), F.col("_k"))),
            ).alias("toAssignee"),
            F.when(F.col("event_type") == "error", F.col("_k") % 6).alias("fromPriority"),
            F.when(F.col("event_type").isin("error", "click"), F.col("_k") % 4).alias("toPriority"),
        )

    def code_nodes(self) -> DataFrame:
        """Pull requests and issues in the nested shape of a code host's API, one per document."""
        d = self.raw("documents")
        stamp = F.date_format(
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        )
        is_pr = F.col("doc_id") % 2 == 0

        def logins(*values: Column) -> Column:
            return F.array(*[F.struct(v.alias("login")) for v in values])

        def ref(value: Column) -> Column:
            return F.when(is_pr, F.struct(value.alias("ref")))

        return d.select(
            F.col("doc_id").alias("id"),
            (F.col("doc_id") + 1000).alias("number"),
            F.left(F.translate("text", "\n", " "), F.lit(60)).alias("title"),
            F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("body"),
            F.when(F.col("doc_id") % 3 == 0, "closed").otherwise("open").alias("state"),
            F.struct(F.concat(F.lit("dev"), F.col("doc_id") % 23).alias("login")).alias("user"),
            ref(F.concat(F.lit("feat/"), "lang")).alias("head"),
            ref(F.lit("main")).alias("base"),
            F.array(F.struct(F.col("lang").alias("name"))).alias("labels"),
            logins(F.concat(F.lit("rev"), F.col("doc_id") % 5)).alias("requested_reviewers"),
            logins(F.col("source"), F.col("lang")).alias("assignees"),
            F.concat(F.lit("https://code.example/"), "doc_id").alias("html_url"),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
            F.when(is_pr & (F.col("doc_id") % 3 == 0), stamp).alias("merged_at"),
            F.when(~is_pr & (F.col("doc_id") % 3 == 0), stamp).alias("closed_at"),
            F.when(is_pr, F.struct(F.lit("x").alias("url"))).alias("pull_request"),
        )

    # -- messages and model calls --------------------------------------------------------------

    def messages(self) -> DataFrame:
        c = self.raw("conversations")
        assistant = F.col("role") == "assistant"
        return c.select(
            F.concat(F.lit("ses_"), "conv_id").alias("session_id"),
            F.col("turn").alias("seq"),
            F.when(assistant, "assistant").otherwise("human").alias("from_agent"),
            F.when(assistant, "human").otherwise("assistant").alias("to_agent"),
            F.col("text").alias("content"),
            (F.col("turn") < 2).alias("read"),
            F.timestamp_seconds(
                F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60
            ).alias("created_at"),
        )

    def model_calls(self) -> DataFrame:
        c = self.raw("conversations")
        assistant = F.col("role") == "assistant"
        length = F.length("text").cast("long")
        zero = F.lit(0).cast("long")
        even = F.col("conv_id") % 2 == 0
        key = F.concat(F.lit("run_"), "conv_id")
        model = F.element_at(
            F.array(*[F.lit(m) for m in ("m-small", "m-large", "m-mid", "m-unpriced")]),
            (F.col("conv_id") % 4 + 1).cast("int"),
        )
        return c.select(
            F.concat(F.lit("call_"), "conv_id", F.lit("_"), "turn").alias("call_id"),
            F.timestamp_seconds(
                F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60
            ).alias("created_at"),
            F.concat(F.lit("rt_"), F.col("conv_id") % 9).alias("runtime_id"),
            F.when(F.col("conv_id") % 3 == 0, "triage").otherwise("extraction").alias("consumer"),
            key.alias("run_id"),
            F.col("turn").alias("turn_index"),
            model.alias("model"),
            F.when(assistant, "stop").otherwise("tool_calls").alias("finish_reason"),
            F.concat(F.lit("prompt "), F.col("conv_id") % 12).alias("prompt"),
            F.when(assistant, zero).otherwise(length).alias("input_tokens"),
            F.when(assistant, length).otherwise(zero).alias("output_tokens"),
            zero.alias("cache_creation_tokens"),
            zero.alias("cache_read_tokens"),
            F.when(even, F.concat(F.lit("order_"), "conv_id")).alias("record_id"),
            F.when(~even, F.concat(F.lit("ses_"), "conv_id")).alias("session_id"),
        )

    def prices(self) -> DataFrame:
        """$ per million tokens of the models that `model_calls` names."""
        rows = [
            ("m-small", 0.25, 2.0, 0.25, 0.025),
            ("m-mid", 1.0, 5.0, 1.25, 0.1),
            ("m-large", 3.0, 15.0, 3.75, 0.3),
        ]
        return small_table(
            self.spark,
            rows,
            "model string, input double, output double, cache_write double, cache_read double",
        )

    # -- extractions ---------------------------------------------------------------------------

    def extractions(self) -> DataFrame:
        """Nested extractor output, one per order line, with planted mistakes by key."""
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        li = spread(li, "l_orderkey")
        part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        supp = self.raw("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"
        )
        x = li.join(part, "l_partkey").join(supp, "l_suppkey")
        none = F.lit(None).cast("string")
        even = F.col("l_linenumber") % 2 == 0
        mark = F.col("l_orderkey") % 50

        def entity(name, kind, bag, resolved, canonical):
            return F.struct(
                name.alias("name"),
                F.lit(kind).alias("type"),
                bag.alias("metadata"),
                resolved.alias("resolved_to"),
                canonical.alias("canonical_name"),
            )

        def claim(label, kind, text, source, target, confidence, until=none):
            return F.struct(
                label.alias("edge_label"),
                kind.alias("fact_type"),
                text.alias("fact"),
                source.alias("from_entity"),
                target.alias("to_entity"),
                confidence.alias("confidence"),
                until.cast("string").alias("valid_until"),
            )

        company = entity(
            F.col("s_name"),
            "company",
            F.create_map(
                F.lit("domain"), F.concat(F.lit("n"), "s_nationkey", F.lit(".example"))
            ),
            F.lit("new"),
            F.col("s_name"),
        )
        project_name = F.when(even, F.upper("p_name")).otherwise(F.col("p_name"))
        project = entity(
            F.when(even, F.concat(F.lit("the "), "p_name")).otherwise(F.col("p_name")),
            "project",
            F.create_map(F.lit("line"), F.col("l_linenumber").cast("string")),
            F.when(mark == 7, F.lit("project:-1"))
            .when(even, F.concat(F.lit("project:"), "l_partkey"))
            .otherwise(F.lit("new")),
            F.col("p_name"),
        )
        target = F.when(even, F.concat(F.lit("the "), "p_name")).otherwise(F.col("p_name"))
        supplies = claim(
            F.when(mark == 11, "CLAIMED").otherwise("AFFILIATED"),
            F.lit("contributor"),
            F.concat("s_name", F.lit(" supplies "), "p_name"),
            F.col("s_name"),
            F.when(mark == 13, F.lit("Nobody")).otherwise(target),
            F.when(even, "inferred").otherwise("stated"),
        )
        pledge = claim(
            F.lit("ASSERTED"),
            F.when(mark == 17, "pledge").otherwise("commitment"),
            F.when(mark == 19, F.lit("something else entirely was said here")).otherwise(
                F.concat("s_name", F.lit(" will deliver "), "p_name")
            ),
            F.when(mark == 23, F.lit("Somebody")).otherwise(F.col("s_name")),
            none,
            F.lit("stated"),
            F.lit("1998-06-30"),
        )
        return x.select(
            F.concat_ws("_", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .alias("record_id"),
            F.lit("order_line").alias("record_type"),
            F.concat("s_name", F.lit(" supplies "), "p_name", F.lit("; "), project_name).alias(
                "content"
            ),
            F.create_map(
                F.lit("received_at"),
                F.when(even, F.lit("1997-03-01T02:00:00Z")).otherwise(F.lit("")),
                F.lit("op_area"),
                F.when(mark < 25, F.lit("intention")),
            ).alias("metadata"),
            F.lit("1998-01-01 12:00:00").cast("timestamp").alias("created_at"),
            F.array(company, project).alias("entities"),
            F.array(supplies, pledge).alias("facts"),
        )
