"""Whether questions can be answered from evidence, and what the evidence says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.extraction import noise_flags
from docspark.operators.names import folded, query_entities

#: Other forms of common technical abbreviations.
VARIANTS = {
    "rag": ("检索增强", "retrieval augmented", "retrieval-augmented", "retrieval augmented generation"),
    "llm": ("大模型", "大语言模型", "large language model"),
    "agent": ("智能体",),
    "nlp": ("自然语言处理", "natural language processing"),
    "ml": ("机器学习", "machine learning"),
    "ai": ("人工智能", "artificial intelligence"),
    "kg": ("知识图谱", "knowledge graph"),
    "ocr": ("光学字符识别", "文字识别"),
    "gpt": ("generative pre",),
    "bm25": ("best matching 25",),
}
#: Marks of what a piece of evidence is about.
PROJECT = ("项目经历", "项目经验", "项目名称", "项目背景", "项目简介", "负责", "参与开发", "参与设计", "主导", "职责", "成果", "交付", "系统设计", "架构设计", "落地", "上线")
CONCEPT = ("是一种", "是 一种", "指的是", "是指", "定义为", "概念", "定义", "原理", "会根据", "可以用来", "被用来")
PERSON = ("姓名", "联系方式", "电话", "邮箱", "个人简介", "性别", "出生")
METADATA = ("基本信息", "目录", "标题", "版本", "编制", "页数")
#: Phrases of general knowledge, and of claims that deny.
OUTSIDE = ("一般来说", "通常来说", "根据一般知识", "根据常识", "根据通用知识", "建议联系管理员", "联系资料库管理员", "联系管理员", "最新版本可能有", "通常用于", "通常会", "一般会", "你可以参考", "你可以查阅", "一般来说包括")
NEGATIVE = ("没有找到", "未找到", "未提及", "没有提到", "未出现", "不足以", "无法确认")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def appears(entity: Column, lower_text: Column) -> Column:
    """Whether an entity or another form of it stands in a text in lower case.

    Forms of up to three characters must stand apart from ASCII letters and digits; Han forms and longer ones may stand
    anywhere.
    """
    others = F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    forms = F.concat(F.array(entity), F.coalesce(others[entity], F.array().cast("array<string>")))
    apart = lambda f: F.regexp(lower_text, F.concat(F.lit("(?:^|[^0-9A-Za-z])"), f, F.lit("(?:$|[^0-9A-Za-z])")))
    short = lambda f: (F.length(f) <= 3) & ~f.rlike(r"[\x{4E00}-\x{9FFF}]")
    return F.exists(forms, lambda f: F.when(short(f), apart(f)).otherwise(F.contains(lower_text, f)))


def lower_evidence(text: Column, heading: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), heading))


def entity_hits(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """``question_id, entity, hits``: pieces of the question's evidence (``question_id, text, heading``) with each entity."""
    e = evidence.select("question_id", lower_evidence(F.col("text"), F.col("heading")).alias("t"))
    found = entities.join(e, "question_id", "left").withColumn("hit", F.coalesce(appears(F.col("entity"), F.col("t")), F.lit(False)))
    return found.groupBy("question_id", "entity").agg(F.count_if("hit").alias("hits"))


def evidence_role(text: Column, heading: Column) -> Column:
    """``project``, ``person``, ``document_metadata``, ``concept``, ``fact`` or ``other``: the heading tells first, then the text.

    A fact has two ASCII digits or more in at most 200 characters.
    """
    h, t = F.coalesce(heading, F.lit("")), F.coalesce(text, F.lit(""))
    role = F.when(any_of(h, PROJECT), "project").when(any_of(h, PERSON), "person").when(any_of(h, METADATA), "document_metadata")
    role = role.when(any_of(t, PROJECT), "project").when(any_of(t, CONCEPT), "concept").when(any_of(t, PERSON), "person").when(any_of(t, METADATA), "document_metadata")
    return role.when((F.regexp_count(t, F.lit("[0-9]")) >= 2) & (F.length(t) <= 200), "fact").otherwise("other")


def answerability(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """``question_id, status, confidence, reason, missing`` of questions (``text, needs_project``) and their evidence.

    Not answerable without evidence, with none of the question's entities in it, or without a project's evidence where that
    is needed; partly if some entities are missing (listed in the question's order).
    """
    q = questions.select("question_id", query_entities(F.col("text")).alias("entities"), F.coalesce("needs_project", F.lit(False)).alias("needs"))
    hits = entity_hits(q.select("question_id", F.explode("entities").alias("entity")), evidence).filter("hits > 0").groupBy("question_id").agg(F.collect_set("entity").alias("matched"))  # eight a question
    seen = evidence.groupBy("question_id").agg(F.bool_or(evidence_role(F.col("text"), F.col("heading")) == "project").alias("project"))
    j = q.join(hits, "question_id", "left").join(seen, "question_id", "left")
    matched = F.coalesce("matched", F.array().cast("array<string>"))
    missing, some = F.array_except("entities", matched), F.size("entities") > 0
    verdict = lambda status, confidence, reason: F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    v = F.when(F.col("project").isNull(), verdict("not_answerable", 0.0, "no_evidence"))
    v = v.when(some & (F.size(matched) == 0), verdict("not_answerable", 0.15, "entity_mismatch"))
    v = v.when(F.col("needs") & ~F.col("project"), verdict("not_answerable", 0.2, "existence_requires_project_context"))
    v = v.when(F.size(missing) > 0, verdict("partial", 0.45, "partial_entity_coverage"))
    v = v.when(~some, verdict("answerable", 0.55, "no_strong_entities")).otherwise(verdict("answerable", 0.9, "entities_consistent"))
    return j.select("question_id", v.alias("v"), F.array_join(F.when(F.col("project").isNull(), F.array().cast("array<string>")).otherwise(missing), ",").alias("missing")).select("question_id", "v.*", "missing")


def first_of(text: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words``, in their order, that a text holds, else null."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(0))


def claim_flags(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """``claim_id, missing_entity, outside``: the first entity of a claim that none of its quotes has (claims that deny are exempt), and the
    first phrase of general knowledge in it. Claims: ``claim_id, text``; quotes: ``claim_id, quote``."""
    c = claims.select("claim_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"deny": any_of(F.col("text"), NEGATIVE), "entities": query_entities(F.col("text"))})
    asked = c.filter("not deny").select(F.col("claim_id").alias("question_id"), F.posexplode("entities").alias("pos", "entity"))
    none = entity_hits(asked.select("question_id", "entity"), quotes.select(F.col("claim_id").alias("question_id"), F.col("quote").alias("text"), F.lit(None).cast("string").alias("heading"))).filter("hits = 0")
    first = none.join(asked, ["question_id", "entity"]).groupBy(F.col("question_id").alias("claim_id")).agg(F.min_by("entity", "pos").alias("missing_entity"))
    return c.join(first, "claim_id", "left").select("claim_id", "missing_entity", first_of(F.col("text"), OUTSIDE).alias("outside"))


def extractive_answer(hits: DataFrame, limit: int = 8, max_files: int = 5, most: int = 260) -> DataFrame:
    """``question_id, claim, file_id, text``: claims from the first ``limit`` hits (``question_id, place, file_id, quote``).

    Hits of files beyond the first ``max_files`` to appear are left out, and of equal summaries of machine noise all but the
    first; other repeats stay.
    """
    by_question = Window.partitionBy("question_id")
    h = hits.filter(F.col("place") <= limit)  # places are from 1
    seen = h.withColumn("first", F.min("place").over(Window.partitionBy("question_id", "file_id")))
    seen = seen.withColumn("file_no", F.dense_rank().over(by_question.orderBy("first"))).filter(F.col("file_no") <= max_files)
    markup, opaque = noise_flags(F.col("text"))
    seen = seen.withColumn("text", folded(F.col("quote"), most)).withColumn("noise", markup | opaque)
    again = F.row_number().over(Window.partitionBy("question_id", "text").orderBy("place"))
    kept = seen.withColumn("again", again).filter("not noise or again = 1")
    return kept.select("question_id", F.row_number().over(by_question.orderBy("place")).alias("claim"), "file_id", "text")
