"""Prompt assembly over grouped rows; P4/J7 inference hook."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prompt and message texts.
CHAT_INSTRUCTION = ("Answer concisely and directly based on the provided data in a "
                    "professional manner. Do NOT add introductions. Query: ")
RANKED_HEAD = "Here are relevant documents:\n\n"
RANKED_TAIL = "\n\nNow answer: "
NO_DOCS_HEAD = "⚠️ No relevant documents found in "
NO_DOCS_TAIL = ". Please ensure data is uploaded."


def chat_parts(requests: DataFrame, context: DataFrame) -> DataFrame:
    """P1 + P3 as ordered rows: scope, query_id, pos, kind, text.

    ``context`` rows (scope, pos, text, from ``scoped_context``; query_id null) belong to every request of
    their scope.  Each request adds one row behind them: its ``instruction``, or the ``response`` that its
    scope holds no documents.  A prompt is the context texts joined by blank lines and the instruction.
    Nothing is cut or gathered in one value; whether a scope was found comes from the key match alone."""
    sizes = context.groupBy("scope").agg(F.count("*").alias("_n"))
    found = F.col("_n").isNotNull()
    asked = requests.join(sizes, "scope", "left").select(
        "scope", "query_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("pos"),
        F.when(found, F.lit("instruction")).otherwise(F.lit("response")).alias("kind"),
        F.when(found, F.concat(F.lit("\n\n" + CHAT_INSTRUCTION), F.col("query")))
        .otherwise(no_documents_message()).alias("text"))
    rows = context.select("scope", F.lit(None).cast(requests.schema["query_id"].dataType).alias("query_id"),
                          F.col("pos").cast("bigint").alias("pos"), F.lit("context").alias("kind"), "text")
    return rows.unionByName(asked)


def assemble_prompts(parts: DataFrame, budget: int) -> DataFrame:
    """(query_id, prompt, response) of ``chat_parts`` rows for a model that takes ``budget`` characters of
    context: the leading context rows that fit, joined by blank lines, and the instruction.

    ``pos`` numbers the rows of a scope and each takes its separator, so no row past ``budget`` / 2 can fit; of
    the others only positions and lengths are summed up, and texts join what is kept."""
    from .retrieval import context_budget, ordered_concat

    context = parts.where((F.col("kind") == "context") & (F.col("pos") <= budget // 2))
    sizes = context.select("scope", "pos", F.length("text").alias("n_chars"))
    kept = context_budget(sizes, [F.col("pos")], budget, group="scope", size=F.col("n_chars"))
    texts = ordered_concat(kept.join(context.select("scope", "pos", "text"), ["scope", "pos"]), ["scope"], "pos")
    asked = parts.where("kind <> 'context'").join(texts, "scope", "left")
    instruction = F.col("kind") == "instruction"
    return asked.select("query_id", F.when(instruction, F.concat(F.coalesce("context", F.lit("")), F.col("text"))).alias("prompt"),
                        F.when(~instruction, F.col("text")).alias("response"))


def ranked_prompt(df: DataFrame, context: str = "context", query: str = "query") -> DataFrame:
    """CLI prompt around the ranked context."""
    return df.withColumn("prompt", F.concat(F.lit(RANKED_HEAD), F.col(context),
                                            F.lit(RANKED_TAIL), F.col(query)))


def scope_description(folder: str = "folder_name", document: str = "document_name"):
    """Document, else folder, else 'your documents'."""
    return (F.when(F.col(document).isNotNull() & (F.col(document) != ""),
                   F.concat(F.lit("document '"), F.col(document), F.lit("'")))
            .when(F.col(folder).isNotNull() & (F.col(folder) != ""),
                  F.concat(F.lit("folder '"), F.col(folder), F.lit("'")))
            .otherwise(F.lit("your documents")))


def ranked_prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    """P2 for every question: (query_id, prompt, response).  ``context`` (query_id, context) holds the
    questions with hits (an empty context: none fitted); the others get the no-documents answer."""
    j = questions.join(context, "query_id", "left").withColumn("_found", F.col("context").isNotNull())
    out = ranked_prompt(j.withColumn("context", F.coalesce("context", F.lit(""))))
    return out.select("query_id", F.when(F.col("_found"), F.col("prompt")).alias("prompt"),
                      F.when(~F.col("_found"), F.lit(NO_DOCS_HEAD + "your documents" + NO_DOCS_TAIL)).alias("response"))


def no_documents_message(folder: str = "folder_name", document: str = "document_name"):
    return F.concat(F.lit(NO_DOCS_HEAD), scope_description(folder, document), F.lit(NO_DOCS_TAIL))


def infer(df: DataFrame, fn: Callable[[list[str]], list[str]], input_col: str = "prompt",
          out_col: str = "response", dedupe: bool = True) -> DataFrame:
    """P4 + J7: run a caller-supplied batch function on executors.

    With ``dedupe`` each distinct input is computed once: distinct inputs
    (keyed by md5) go through ``mapInPandas`` and the outputs are joined back.
    """
    def run(batches):
        for pdf in batches:
            pdf[out_col] = list(fn(pdf[input_col].tolist())) if len(pdf) else []
            yield pdf[["_k", out_col]]

    if not dedupe:
        def run_all(batches):
            for pdf in batches:
                pdf[out_col] = list(fn(pdf[input_col].tolist())) if len(pdf) else []
                yield pdf
        return df.mapInPandas(run_all, schema=T.StructType(
            df.schema.fields + [T.StructField(out_col, T.StringType())]))
    schema = T.StructType([T.StructField("_k", T.StringType()),
                           T.StructField(out_col, T.StringType())])
    keyed = df.withColumn("_k", F.md5(F.col(input_col)))
    distinct_inputs = keyed.select("_k", input_col).dropDuplicates(["_k"])
    outputs = distinct_inputs.mapInPandas(run, schema=schema)
    return keyed.join(outputs, "_k", "left").drop("_k")


def text_length_fn(texts: list[str]) -> list[str]:
    """Deterministic stand-in model used by the fixture query: output = length."""
    return [str(len(t)) for t in texts]
