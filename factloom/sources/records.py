"""Source payloads to records: one DataFrame mapping per record type.

Every mapping gives `content` (the text an extractor reads), `metadata` (flat text values; lists as
JSON text), `dedup_key` and `classification` (only set where the mapping itself can decide). The
labels and the line order of `content` are fixed values: stored records already have this form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.columns import blank_to_null, priority_label, stable_id, text_or_empty

# --- fixed values -----------------------------------------------------------------------------
AUTOMATED_SENDERS = (
    "no-reply",
    "noreply",
    "donotreply",
    "do-not-reply",
    "mailer-daemon",
    "postmaster@",
)
BULK_PRECEDENCE = ("bulk", "list", "junk")
FINISHED_STATE = "Done"
# --- end of fixed values ----------------------------------------------------------------------


def _bag(**values: Column) -> Column:
    return F.create_map(*[part for k, v in values.items() for part in (F.lit(k), v)])


def _record(
    df: DataFrame,
    record_type: str,
    content: Column,
    metadata: Column,
    key: Column,
    classification: Column | None = None,
) -> DataFrame:
    label = F.lit(None) if classification is None else classification
    # the payload as it came, where the source gives it, else its fields as JSON, nulls included
    payload = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    given = F.col("raw").cast("string") if "raw" in df.columns else F.lit(None)
    context = F.col("human_context") if "human_context" in df.columns else F.lit(None)
    return df.select(
        F.when(F.coalesce(key, F.lit("")) != "", stable_id(record_type, key))
        .otherwise(stable_id(record_type, content))
        .alias("record_id"),
        F.lit(record_type).alias("type"),
        content.alias("content"),
        metadata.alias("metadata"),
        key.alias("dedup_key"),
        label.cast("string").alias("classification"),
        F.coalesce(given, payload).alias("raw"),
        context.cast("string").alias("human_context"),
    )


def _either(df: DataFrame, *names: str) -> DataFrame:
    """`df` with the first column named, which has the first value that is not blank of all that it has."""
    there = [blank_to_null(c) for c in names if c in df.columns]
    return df.withColumn(names[0], F.coalesce(*there, F.lit(None).cast("string")))


def _lines(*pairs: tuple[str, Column]) -> Column:
    parts = [x for label, value in pairs for x in (F.lit(label), value, F.lit("\n"))]
    return F.concat(*parts)


def _up_to(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.left(text, F.lit(chars))


def _body(body: str, chars: int | None) -> Column:
    given = F.coalesce(F.col(body), F.lit("")) != ""
    return F.when(given, F.concat(F.lit("\n"), _up_to(F.col(body), chars))).otherwise("")


def _list_text(column: str) -> Column:
    return F.coalesce(F.to_json(column), F.lit("[]"))


# -- mail -------------------------------------------------------------------------------------


def _header(headers: str, name: str) -> Column:
    """Value of a header, the last one winning, empty when it is not there."""
    hits = F.filter(
        F.coalesce(F.col(headers), F.expr("array()")),
        lambda h: F.lower(h["name"]) == name,
    )
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def mail_noise(sender: str = "sender", headers: str | None = None) -> Column:
    """Clear signs of automatic or bulk mail; anything in doubt is not noise."""
    low = F.lower(text_or_empty(sender))
    noise = F.lit(False)
    for marker in AUTOMATED_SENDERS:
        noise = noise | F.contains(low, F.lit(marker))
    if headers is None:
        return noise
    automatic = F.lower(_header(headers, "auto-submitted"))
    return (
        noise
        | (_header(headers, "list-unsubscribe") != "")
        | ((automatic != "") & (automatic != "no"))
        | F.lower(_header(headers, "precedence")).isin(*BULK_PRECEDENCE)
        | (_header(headers, "x-auto-response-suppress") != "")
    )


def email_records(mail: DataFrame) -> DataFrame:
    """Mail payloads; `recipient` stands for `recipients` where a payload has that name for it."""
    mail = _either(mail, "recipients", "recipient") if "recipient" in mail.columns else mail
    t = text_or_empty
    fields = ("message_id", "thread_id", "sender", "recipients", "subject", "received_at")
    content = F.concat(
        _lines(
            ("From: ", t("sender")),
            ("To: ", t("recipients")),
            ("Subject: ", t("subject")),
            ("Date: ", t("received_at")),
        ),
        F.lit("\n"),
        t("body"),
    )
    headers = "headers" if "headers" in mail.columns else None
    noise = F.when(mail_noise("sender", headers), "noise")
    metadata = _bag(**{f: t(f) for f in fields})
    return _record(mail, "email", content, metadata, F.col("message_id"), classification=noise)


# -- issues -----------------------------------------------------------------------------------


def flatten_issues(nodes: DataFrame) -> DataFrame:
    """Nested issue-tracker nodes to flat issues."""
    t = text_or_empty
    return nodes.select(
        t("id").alias("id"),
        t("identifier").alias("identifier"),
        t("title").alias("title"),
        "description",
        t("state.name").alias("status"),
        t("priorityLabel").alias("priority"),
        F.col("priority").alias("priority_number"),
        t("assignee.name").alias("assignee"),
        t("assignee.email").alias("assignee_email"),
        t("project.name").alias("project"),
        F.coalesce(F.col("labels.nodes.name"), F.expr("array()")).alias("labels"),
        F.transform(
            F.coalesce(F.col("comments.nodes"), F.expr("array()")),
            lambda c: F.struct(
                F.coalesce(c["body"], F.lit("")).alias("body"),
                F.coalesce(c["user"]["name"], F.lit("")).alias("author"),
                F.coalesce(c["createdAt"], F.lit("")).alias("created_at"),
            ),
        ).alias("comments"),
        t("url").alias("url"),
        t("createdAt").alias("created_at"),
        t("updatedAt").alias("updated_at"),
    )


def issue_records(
    issues: DataFrame, body_chars: int | None = None, comment_chars: int | None = None
) -> DataFrame:
    """Issues with their comments; whole texts unless a number of characters is given.

    `linear_id` stands for `id`, which is the dedup key, where a payload has that name for it.
    """
    issues = _either(issues, "id", "linear_id") if "linear_id" in issues.columns else issues
    t = text_or_empty
    spoken = F.filter("comments", lambda c: c["body"] != "")
    comment_lines = F.transform(
        spoken,
        lambda c: F.concat(
            F.lit("  ["), c["author"], F.lit("] "), _up_to(c["body"], comment_chars), F.lit("\n")
        ),
    )
    comments = F.when(
        F.size("comments") > 0, F.concat(F.lit("\n\nComments:\n"), F.array_join(comment_lines, ""))
    ).otherwise("")
    content = F.concat(
        F.lit("Issue: "),
        t("identifier"),
        F.lit(" — "),
        t("title"),
        F.lit("\n"),
        _lines(
            ("Status: ", t("status")),
            ("Priority: ", t("priority")),
            ("Assignee: ", t("assignee")),
            ("Project: ", t("project")),
            ("URL: ", t("url")),
        ),
        _body("description", body_chars),
        comments,
    )
    metadata = _bag(
        linear_id=t("id"),
        **{
            c: t(c)
            for c in ("identifier", "title", "status", "priority", "assignee", "project", "url")
        },
        labels=_list_text("labels"),
        linear_created_at=t("created_at"),
        linear_updated_at=t("updated_at"),
        op_area=F.lit("reality"),
    )
    return _record(issues, "linear_issue", content, metadata, F.col("id"))


def history_changes(history: DataFrame, since: str | None = None) -> DataFrame:
    """One history node to up to three changes: status, assignee, priority."""
    kept = history if since is None else history.filter(F.col("createdAt") > since)
    t = text_or_empty

    def change(field, suffix, keep, before, after):
        return F.struct(
            F.concat(F.col("id"), F.lit(suffix)).alias("id"),
            F.lit(field).alias("field"),
            before.alias("from_value"),
            after.alias("to_value"),
            F.coalesce(keep, F.lit(False)).alias("keep"),
        )

    def either(a, b):
        return F.col(a).isNotNull() | F.col(b).isNotNull()

    changes = F.array(
        change(
            "status", "", either("fromState", "toState"), t("fromState.name"), t("toState.name")
        ),
        change(
            "assignee",
            "_assignee",
            either("fromAssignee", "toAssignee"),
            t("fromAssignee.name"),
            t("toAssignee.name"),
        ),
        change(
            "priority",
            "_priority",
            ~F.col("fromPriority").eqNullSafe(F.col("toPriority")),
            priority_label("fromPriority"),
            priority_label("toPriority"),
        ),
    )
    exploded = kept.select(
        "issue_id",
        t("createdAt").alias("created_at"),
        t("actor.name").alias("actor"),
        F.explode_outer(F.filter(changes, lambda c: c["keep"])).alias("c"),
    ).filter(F.col("c").isNotNull())
    return exploded.select(
        "c.id", "issue_id", "created_at", "actor", "c.field", "c.from_value", "c.to_value"
    )


def change_records(changes: DataFrame) -> DataFrame:
    t = text_or_empty
    issue = stable_id("linear_issue", "issue_id")
    content = F.concat(
        F.lit("Issue "),
        issue,
        F.lit(": "),
        t("field"),
        F.lit(" changed from '"),
        t("from_value"),
        F.lit("' to '"),
        t("to_value"),
        F.lit("' by "),
        t("actor"),
        F.lit(" at "),
        t("created_at"),
    )
    metadata = _bag(
        issue_record_id=issue,
        field=t("field"),
        from_value=t("from_value"),
        to_value=t("to_value"),
        changed_by=t("actor"),
        changed_at=t("created_at"),
        linear_history_id=t("id"),
    )
    return _record(changes, "linear_issue_change", content, metadata, F.col("id"))


# -- code host --------------------------------------------------------------------------------


def without_pull_requests(api_issues: DataFrame) -> DataFrame:
    """A code host lists pull requests among its issues; those are not issues."""
    return api_issues.filter(F.col("pull_request").isNull())


def flatten_pull_requests(nodes: DataFrame) -> DataFrame:
    t = text_or_empty
    return nodes.select(
        F.col("id").alias("github_id"),
        "number",
        t("title").alias("title"),
        t("body").alias("body"),
        t("state").alias("state"),
        t("user.login").alias("author"),
        t("head.ref").alias("branch"),
        t("base.ref").alias("base_branch"),
        F.col("labels.name").alias("labels"),
        F.col("requested_reviewers.login").alias("reviewers"),
        t("html_url").alias("url"),
        t("created_at").alias("created_at"),
        t("updated_at").alias("updated_at"),
        t("merged_at").alias("merged_at"),
    )


def flatten_code_issues(nodes: DataFrame) -> DataFrame:
    t = text_or_empty
    return nodes.select(
        F.col("id").alias("github_id"),
        "number",
        t("title").alias("title"),
        t("body").alias("body"),
        t("state").alias("state"),
        t("user.login").alias("author"),
        F.col("assignees.login").alias("assignees"),
        F.col("labels.name").alias("labels"),
        t("html_url").alias("url"),
        t("created_at").alias("created_at"),
        t("updated_at").alias("updated_at"),
        t("closed_at").alias("closed_at"),
    )


def _code_metadata(columns: list[str]) -> Column:
    lists = ("labels", "reviewers", "assignees")
    return _bag(**{c: _list_text(c) if c in lists else text_or_empty(c) for c in columns})


def pull_request_records(prs: DataFrame, body_chars: int | None = None) -> DataFrame:
    t = text_or_empty
    content = F.concat(
        F.lit("PR #"),
        t("number"),
        F.lit(": "),
        t("title"),
        F.lit("\n"),
        _lines(("Author: ", t("author")), ("State: ", t("state"))),
        F.lit("Branch: "),
        t("branch"),
        F.lit(" → "),
        t("base_branch"),
        F.lit("\n"),
        _lines(("URL: ", t("url"))),
        _body("body", body_chars),
    )
    metadata = _code_metadata([c for c in prs.columns if c != "body"])
    return _record(prs, "github_pr", content, metadata, t("github_id"))


def code_issue_records(issues: DataFrame, body_chars: int | None = None) -> DataFrame:
    t = text_or_empty
    content = F.concat(
        F.lit("Issue #"),
        t("number"),
        F.lit(": "),
        t("title"),
        F.lit("\n"),
        _lines(("Author: ", t("author")), ("State: ", t("state")), ("URL: ", t("url"))),
        _body("body", body_chars),
    )
    metadata = _code_metadata([c for c in issues.columns if c != "body"])
    return _record(issues, "github_issue", content, metadata, t("github_id"))


def route_by_shape(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits flat payloads into (pull requests, issues) by the fields they carry."""
    shape = F.lit(False)
    for name in ("branch", "base_branch", "merged_at"):
        if name in payloads.columns:
            shape = shape | F.col(name).isNotNull()
    return payloads.filter(shape), payloads.filter(~shape)


# -- common -----------------------------------------------------------------------------------


def incremental_since(
    df: DataFrame, cursor: str, column: str = "updated_at", status: str | None = None
) -> DataFrame:
    """Rows changed after the cursor; the bound is exclusive."""
    kept = df.filter(F.col(column) > cursor)
    return kept if status is None else kept.filter(F.col("status") == status)


MAPPINGS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "email": email_records,
    "linear_issue": issue_records,
    "linear_issue_change": change_records,
    "github_pr": pull_request_records,
    "github_issue": code_issue_records,
}


def records_from(
    record_type: str,
    payloads: DataFrame,
    arrived_at: Column,
    expert_name: str = "",
    expert_version: str = "",
    mappings: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Payloads of a declared type as full record rows. Callers may add their own mappings."""
    shaped = {**MAPPINGS, **(mappings or {})}[record_type](payloads)
    return shaped.select(
        "record_id",
        "type",
        F.lit(expert_name).alias("source"),
        arrived_at.alias("created_at"),
        "content",
        F.col("metadata").cast(T.MapType(T.StringType(), T.StringType())).alias("metadata"),
        "dedup_key",
        F.lit(expert_name).alias("expert_name"),
        F.lit(expert_version).alias("expert_version"),
        F.lit(False).alias("indexed"),
        "classification",
    )
