"""W1 statement rows, W2 direction, W3 closing balance, A11 totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.patterns import quote
from inkwell.functions.text import let, matched, rx, squeeze, strip
from inkwell.operators.extract import summary_amount_sql
from inkwell.session import cut_lineage

# Shapes of statement lines; amounts may have a sign where a word begins.
ROW_DATE = r"(?:(\d{1,6})\s+)?(\d{2}[/\-\.]\d{2}[/\-\.]\d{2,4})\b"
HEADER = (
    r"\b(?:Transaction\s*Details|ACCOUNT\s*SUMMARY|END\s*OF\s*REPORT|DISCLAIMER|DATE\s+TRAN|Guidelines\s+for|"
    r"Remember\s+that|Branch\s+Office|Customer\s+Address|Registered\s+Mobile|Account\s+Number|Nomination|"
    r"Account\s+Type|Customer\s+ID|IFSC|MICR)\b"
)
BLOCK_AMOUNTS = r"((?:(?<!\S)-)?[\d,]+\.\d{2})\s+(CR|DR|Cr|Dr)\s+(-?[\d,]+\.\d{2})"
BLOCK_HEADER = r"Branch Name|Debit/Credit|Balance\(INR\)|Transaction\s+Date"
EXPLICIT_ROW = r"^(.*?)\s+(-?[\d,]+\.?\d*)\s+(CR|DR|Cr|Dr)\s*(-?[\d,]+\.?\d*)?\s*$"
TRAILING_BALANCE = r"((?:(?<!\S)-)?[\d,]+\.\d{2})\s*(?:Cr\.?|Dr\.?|CR|DR)?\s*$"
TRAILING_AMOUNT = r"((?:(?<!\S)-)?[\d,]+\.\d{2})\s*$"
CREDIT_WORDS = r"~CR~|\bCR\b|\bCREDIT\b|\bDEPOSIT\b|\bNEFT-IN\b"
OPENING_LABEL = r"Opening\s*Balance[\s:]+(?:Rs\.?|INR)?\s*(-?[\d,]+\.?\d*)"
CLOSING_LABEL = r"(?<!Opening\s)\bClosing\s*Balance[\s:]+(?:Rs\.?|INR)?\s*(-?[\d,]+\.?\d*)"

_GLUE = "\u0001"


def _money(col: Column) -> Column:
    return F.nullif(F.replace(col, F.lit(","), F.lit("")), F.lit(""))


def _row(date: Column, description: Column, amount: Column, kind: Column, balance: Column) -> Column:
    return F.struct(
        date.alias("date"), description.alias("description"), amount.alias("amount"), kind.alias("type"), balance.alias("balance")
    )


def _block_rows(text: Column) -> Column:
    """Rows of pages whose transactions are blocks between blank lines."""
    date_in_block = rf"(?:^|\n)\s*{ROW_DATE}"

    def block(b: Column) -> Column:
        header = b.rlike(rx(HEADER, ignore_case=True)) & ~b.rlike(rx(r"^\s*\d+\s+\d{2}[/\-\.]", multiline=True))
        usable = ~header & b.rlike(rx(date_in_block)) & b.rlike(rx(BLOCK_AMOUNTS))

        def part(line: Column) -> Column:
            amounts_at = F.regexp_instr(line, F.lit(rx(BLOCK_AMOUNTS)))
            column = F.when(F.length(line) > 35, strip(F.substr(line, F.lit(36)))).otherwise(strip(line))
            return (
                F.when(line.rlike(rx(BLOCK_HEADER, ignore_case=True)), "")
                .when(amounts_at > 0, strip(line.substr(F.lit(1), amounts_at - 1)))
                .when(column.rlike(r"^(?:\d{1,6}\s+)?\d{2}[/\-\.]\d{2}[/\-\.]\d{2,4}"), "")
                .otherwise(column)
            )

        parts = F.filter(F.transform(F.split(b, "\r?\n"), part), lambda p: p != "")
        return F.when(
            usable,
            _row(
                F.regexp_extract(b, rx(date_in_block), 2), strip(squeeze(F.array_join(parts, " "))),
                _money(F.regexp_extract(b, rx(BLOCK_AMOUNTS), 1)), F.upper(F.regexp_extract(b, rx(BLOCK_AMOUNTS), 2)),
                _money(F.regexp_extract(b, rx(BLOCK_AMOUNTS), 3)),
            ),
        )

    return F.array_compact(F.transform(F.split(strip(text), r"\n\s*\n+"), block))


def _line_rows(text: Column) -> Column:
    """Rows of pages with one dated line per transaction.

    Continuation lines are glued to the line before them with one pattern, so
    a page is handled in its own row without a window over lines.
    """
    tidy = F.array_join(F.filter(F.transform(F.split(text, "\r?\n"), strip), lambda line: line != ""), "\n")
    continues = rf"\n(?!\s*{ROW_DATE})(?![^\n]*(?i:{HEADER}))(?![^\n]*\d+\.\d{{2}})"
    lines = F.split(F.regexp_replace(tidy, rx(continues), _GLUE), "\n")

    def line(joined: Column) -> Column:
        pieces = F.split(joined, _GLUE)
        starts = rx(rf"^\s*{ROW_DATE}")
        extra = F.array_join(F.slice(pieces, 2, F.size(pieces)), " ")

        def parse(p: Column) -> Column:
            head, rest = p["head"], p["rest"]

            def full(desc: Column) -> Column:
                text_ = F.when(p["extra"] != "", F.concat(strip(desc), F.lit(" "), p["extra"])).otherwise(strip(desc))
                return F.regexp_replace(text_, r"[ \t]+", " ")

            explicit = rx(EXPLICIT_ROW, ignore_case=True)
            date = F.regexp_extract(head, starts, 2)
            marked = _row(
                date, full(F.regexp_extract(rest, explicit, 1)), _money(F.regexp_extract(rest, explicit, 2)),
                F.upper(F.regexp_extract(rest, explicit, 3)), _money(F.regexp_extract(rest, explicit, 4)),
            )
            balance_re = rx(TRAILING_BALANCE, ignore_case=True)
            before = F.rtrim(F.regexp_replace(rest, balance_re, ""), F.lit(" \t"))
            amount = F.nullif(F.regexp_extract(before, rx(TRAILING_AMOUNT), 1), F.lit(""))
            unmarked = _row(
                date, full(F.regexp_replace(before, rx(TRAILING_AMOUNT), "")), _money(amount), F.lit(None).cast("string"),
                _money(F.regexp_extract(rest, balance_re, 1)),
            )
            return F.when(rest.rlike(explicit), marked).when(rest.rlike(balance_re) & amount.isNotNull(), unmarked)

        opens = pieces[0].rlike(starts) & ~pieces[0].rlike(rx(HEADER, ignore_case=True))
        parts = F.struct(
            pieces[0].alias("head"), F.regexp_replace(pieces[0], starts, "").alias("rest"), extra.alias("extra")
        )
        return F.when(opens, let(parts, parse))

    return F.array_compact(F.transform(lines, line))


def page_rows(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """Transactions per page in page order; ``type`` is NULL where unmarked."""
    blocks = pages.withColumn("_b", _block_rows(F.col(text)))
    rows = F.when(F.size("_b") > 0, F.col("_b")).otherwise(_line_rows(F.col(text)))
    out = blocks.select("doc_id", "page_num", F.posexplode(rows).alias("seq", "_r"))
    return out.select("doc_id", "page_num", "seq", "_r.*")


def carry_last(df: DataFrame, values: dict[str, Column], keys: list[str], order: list[str], chunk: list[str]) -> DataFrame:
    """Add, per output name, the last non-null value of earlier rows of a key.

    A window over whole keys would put a huge key into one task.  Here each
    chunk (a page, or a stretch of the sequence) is a window of its own, and
    only one row per chunk is carried across chunks.
    """
    in_chunk = Window.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumns({f"_val_{n}": v for n, v in values.items()})
    before = marked.withColumns({f"_in_{n}": F.last(f"_val_{n}", ignorenulls=True).over(in_chunk) for n in values})
    ends = marked.groupBy(*keys, *chunk).agg(*[
        F.max_by(f"_val_{n}", F.when(F.col(f"_val_{n}").isNotNull(), F.struct(*order))).alias(f"_end_{n}") for n in values
    ])
    across = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, *chunk, *[F.last(f"_end_{n}", ignorenulls=True).over(across).alias(f"_carry_{n}") for n in values])
    out = before.join(carried, [*keys, *chunk], "left")
    out = out.withColumns({n: F.coalesce(f"_in_{n}", f"_carry_{n}") for n in values})
    return out.drop(*[f"_{kind}_{n}" for n in values for kind in ("val", "in", "carry")])


def infer_direction(rows: DataFrame, order: list[str], chunk: list[str], opening: DataFrame | None = None) -> DataFrame:
    """Fill a missing CR/DR from the balance movement, else from words."""
    balance = F.col("balance").try_cast("double")
    prev = carry_last(rows, {"_prev": balance}, ["doc_id"], order, chunk)
    if opening is not None:
        start = opening.select("doc_id", F.col("opening_balance").try_cast("double").alias("_open"))
        prev = prev.join(start, "doc_id", "left").withColumn("_prev", F.coalesce("_prev", "_open")).drop("_open")
    described = F.col("description") if "description" in rows.columns else F.lit("")
    by_words = F.when(described.rlike(rx(CREDIT_WORDS, ignore_case=True)), "CR").otherwise("DR")
    inferred = F.when(balance > F.col("_prev"), "CR").when(balance < F.col("_prev"), "DR").otherwise(by_words)
    return prev.withColumn("type", F.coalesce("type", inferred)).drop("_prev")


def opening_balances(docs: DataFrame, text: str = "full_text") -> DataFrame:
    label = _money(matched(F.col(text), OPENING_LABEL, ignore_case=True))
    return docs.select("doc_id", label.alias("opening_balance")).filter("opening_balance IS NOT NULL")


def statement_rows(pages: DataFrame, docs: DataFrame | None = None, text: str = "full_text") -> DataFrame:
    """The transactions table of all pages, numbers kept as text."""
    parsed = cut_lineage(page_rows(pages, text))  # read twice: for the rows and for the ends of pages
    rows = infer_direction(parsed, ["seq"], ["page_num"], opening_balances(docs) if docs is not None else None)
    return rows.select(
        "doc_id", "page_num", "seq", "date", "description", "amount", "type", "balance",
        F.col("amount").try_cast("decimal(18,2)").alias("amount_value"),
        F.col("balance").try_cast("decimal(18,2)").alias("balance_value"),
    )


def last_balances(transactions: DataFrame, order: list[str]) -> DataFrame:
    """Last non-null running balance and row count per document."""
    known = F.when(F.col("balance").isNotNull(), F.struct(*order))
    return transactions.groupBy("doc_id").agg(
        F.max_by("balance", known).alias("last_balance"), F.count("*").alias("n_rows")
    )


def closing_balance(docs: DataFrame, transactions: DataFrame, order: list[str] | None = None,
                    text: str = "full_text") -> DataFrame:
    """Label, else summary table, else last running balance.

    A value equal to the opening balance gives way to the last running
    balance when there are rows.
    """
    last = last_balances(transactions, order or ["page_num", "seq"])
    t = F.col(text)
    summary_close, summary_open = (
        F.expr(summary_amount_sql(text, c)) for c in ("CLOSING BALANCE", "OPENING BALANCE")
    )
    staged = docs.select(
        "doc_id",
        _money(matched(t, CLOSING_LABEL, ignore_case=True)).alias("_label"), summary_close.alias("_summary"),
        F.coalesce(_money(matched(t, OPENING_LABEL, ignore_case=True)), summary_open).alias("opening_balance"),
    ).join(last, "doc_id", "left")
    stated = F.coalesce("_label", "_summary", "last_balance")
    repeats = (stated == F.col("opening_balance")) & (F.col("n_rows") > 0) & (F.col("last_balance") != F.col("opening_balance"))
    source = F.when(F.col("_label").isNotNull(), "label").when(F.col("_summary").isNotNull(), "summary").when(
        F.col("last_balance").isNotNull(), "running"
    )
    return staged.select(
        "doc_id", "opening_balance",
        F.when(F.coalesce(repeats, F.lit(False)), F.col("last_balance")).otherwise(stated).alias("closing_balance"),
        F.when(F.coalesce(repeats, F.lit(False)), "running").otherwise(source).alias("source"),
    )


def transaction_totals(transactions: DataFrame) -> DataFrame:
    """Totals per document; amounts that do not parse are skipped."""
    amount = F.replace(F.col("amount").cast("string"), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    kind = F.upper(F.coalesce("type", F.lit("")))
    t = transactions.withColumn("_a", amount)
    credit, debit = kind.contains("CR"), ~kind.contains("CR") & kind.contains("DR")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_a"))), F.lit(0).cast("decimal(28,2)"))

    ok = F.col("_a").isNotNull()
    return t.groupBy("doc_id").agg(
        F.count("*").alias("n_transactions"), total(ok).alias("total_amount"),
        total(ok & credit).alias("credit_amount"), F.count_if(ok & credit).alias("credit_count"),
        total(ok & debit).alias("debit_amount"), F.count_if(ok & debit).alias("debit_count"),
    )
