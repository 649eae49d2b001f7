"""Evaluation against expected labels, audits, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.config import COLOURS, VERSION, Config
from spanforge.functions.folds import appended
from spanforge.functions.regex import piece
from spanforge.functions.rows import exploded
from spanforge.operators.masking import applied
from spanforge.operators.resolver import category_counts, source_counts


def label_matches(df: DataFrame, expected: str, detected: str) -> DataFrame:
    """The frame with the sizes of the expected set, of its part that was detected, and of what was detected besides."""
    e, d = F.array_distinct(expected), F.array_distinct(detected)
    return df.withColumns({"n_expected": F.size(e), "n_matched": F.size(F.array_intersect(e, d)), "n_extra": F.size(F.array_except(d, e))})


def evaluation(matches: DataFrame) -> DataFrame:
    """One row: documents, label totals, and precision, recall and F1, rounded to four places."""
    total = matches.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(a), F.lit(0)).cast("bigint").alias(b) for a, b in (("n_expected", "expected_labels"), ("n_matched", "matched_labels"), ("n_extra", "extra_labels"))))
    found = F.col("matched_labels") + F.col("extra_labels")
    p, r = F.when(found > 0, F.col("matched_labels") / found).otherwise(1.0), F.when(F.col("expected_labels") > 0, F.col("matched_labels") / F.col("expected_labels")).otherwise(1.0)
    total = total.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return total.withColumn("f1", F.round(f1, 4)).withColumns({"precision": F.round("precision", 4), "recall": F.round("recall", 4)}).select("documents", "expected_labels", "matched_labels", "extra_labels", "precision", "recall", "f1")


def audit(spans: Column, config: Config, *, source_file: Column | None = None, output_file: Column | None = None, warnings: Column | None = None, metadata_stripped: Column | None = None, seconds: Column | None = None) -> Column:
    """The audit report of a document as a struct; ``to_json`` makes its file."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(VERSION).alias("tool_version"),
        (source_file if source_file is not None else none).alias("source_file"),
        (output_file if output_file is not None else none).alias("output_file"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("processed_at"),
        F.round(seconds if seconds is not None else F.lit(0.0), 4).alias("processing_time_seconds"),
        F.array(*map(F.lit, config.layers)).cast("array<string>").alias("layers_used"),
        source_counts(spans, category_counts(spans).alias("by_category")).alias("entities_found"),
        (metadata_stripped if metadata_stripped is not None else F.lit(not config.keep_metadata)).alias("metadata_stripped"),
        F.lit(not config.keep_metadata).alias("track_changes_accepted"),
        F.lit(config.opf_recall_mode if config.opf_enabled else None).cast("string").alias("opf_recall_mode"),
        F.lit(config.low_memory).alias("low_memory"),
        (warnings if warnings is not None else F.array().cast("array<string>")).alias("warnings"),
    )


def counts_by(df: DataFrame, *keys: str, spans_col: str = "spans") -> DataFrame:
    """Spans by keys and label over all documents; counted map-side before the shuffle."""
    return exploded(df, F.transform(spans_col, lambda s: s["label"]), *keys, name="label").groupBy(*keys, "label").agg(F.count("*").alias("n_spans"))


def escaped_html(text: Column) -> Column:
    """HTML-escaped text, quotes included."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlighted(text: Column, spans: Column) -> Column:
    """The text as HTML, each span in its layer's colour with label and source as a tooltip."""
    legend = "".join(f'<span style="background:{c};padding:2px 6px;border-radius:3px">{n}</span> ' for n, c in COLOURS.items())
    colour = lambda s: F.coalesce(*(F.when(s["source"] == n, c) for n, c in COLOURS.items()), F.lit("#e0e0e0"))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        mark = F.concat(F.lit('<span style="background:'), colour(s), F.lit(';padding:1px 3px;border-radius:3px" title="'), s["label"], F.lit(" via "), s["source"], F.lit('">'), escaped_html(piece(text, s["start"], s["end"])), F.lit("</span>"))
        return s["end"], F.array(escaped_html(piece(text, at, s["start"])), mark)

    body = appended(applied(spans), F.lit(0), "string", step, lambda at, out: F.concat(F.array_join(out, ""), escaped_html(F.substring(text, at + 1, F.lit(2**31 - 1)))))
    head, none = f"<div>{legend}</div>", "<em>Nessun testo</em>"
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, head + none).otherwise(F.concat(F.lit(head + "<pre style='white-space:pre-wrap;font-family:monospace'>"), body, F.lit("</pre>")))


def report_lines(report: Column) -> Column:
    """The lines of the compliance report of an audit struct, each of at most 110 characters."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    yes = F.when(report["metadata_stripped"], "True").otherwise("False")
    by = F.array_sort(F.map_entries(report["entities_found"]["by_category"]))
    head = F.array(
        F.lit("Report Compliance GDPR"),
        F.concat(F.lit("File sorgente: "), text(report["source_file"])),
        F.concat(F.lit("File output: "), text(report["output_file"])),
        F.concat(F.lit("Processato: "), text(report["processed_at"])),
        F.concat(F.lit("Layer usati: "), F.array_join(report["layers_used"], ", ")),
        F.concat(F.lit("Metadati rimossi: "), yes),
        F.lit(""),
        F.lit("Entità rilevate:"),
    )
    warned = F.when(F.size(report["warnings"]) > 0, F.concat(F.array(F.lit(""), F.lit("Warning:")), F.transform(report["warnings"], lambda w: F.concat(F.lit("- "), w)))).otherwise(F.array().cast("array<string>"))
    tail = F.array(F.lit(""), F.lit("Audit JSON sintetico:"), F.substring(F.to_json(report, {"ignoreNullFields": "false"}), 1, 1500))
    lines = F.concat(head, F.transform(by, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string"))), warned, tail)
    return F.transform(lines, lambda x: F.substring(x, 1, 110))


def report_pages(lines: Column, height: int = 842, top: int = 48, leading: int = 16) -> Column:
    """The report's lines by page: as many a page as fit between the margins."""
    per_page = (height - 2 * top) // leading + 1
    count = F.greatest(F.ceil(F.size(lines) / per_page).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(lines, i * per_page + 1, F.lit(per_page)))


# The synthetic cases and their expected labels.
CASES = (
    ("Cedolino di Mario Rossi CF RSSMRA80A01L219M tel 3401234567", ("CODICE_FISCALE", "TELEFONO_IT")),
    ("Dipendente Anna Bianchi, CF BNCNNA75T41F205Y, IBAN IT60X0542811101000000123456", ("CODICE_FISCALE", "IBAN_IT")),
    ("Stipendio accreditato su IBAN IT28W0306905020100000017789, matricola INPS 12345678", ("IBAN_IT", "MATRICOLA_INPS")),
    ("Rif. cedolino #2024-04, dipendente: Luca Verdi, CF VRDLCU82M15H501J", ("CODICE_FISCALE",)),
    ("Tessera sanitaria 80380030001234567890, ente: ASL Roma 1", ("TESSERA_SANITARIA",)),
    ("Fornitore: ACME Srl, P.IVA 01114601006, sede legale via Roma 12, 10138 Torino", ("PARTITA_IVA",)),
    ("Cliente Beta S.p.A. partita iva 12345678903, referente sig. Rossi tel 011 1234567", ("PARTITA_IVA", "TELEFONO_IT")),
    ("Coordinate bancarie: IBAN IT60X0542811101000000123456, intestatario Gamma SRL", ("IBAN_IT",)),
    ("PEC studio.rossi@legalmail.pec.it, P.IVA IT 01234567890", ("PEC", "PARTITA_IVA")),
    ("Contratto firmato il 15/03/2024 da Giulia Neri, CF NRIGLI90E45L219P", ("CODICE_FISCALE",)),
    ("Server prod-db-01.acme.local IP 192.168.10.50, admin paolo.bianchi@acme.it", ("IP_ADDRESS", "EMAIL")),
    ("Errore SSH dall'host 10.0.0.42, utente: msmith, password rifiutata", ("IP_ADDRESS",)),
    ("Log: 2024-04-30 12:34:56 - user mario@azienda.it failed login from 192.168.1.100", ("EMAIL", "IP_ADDRESS")),
    ("Connessione VPN dal 172.16.0.5 - account giulia.neri@cliente.it accettato", ("IP_ADDRESS", "EMAIL")),
    ("Backup completato: server 10.10.10.10, riferimento: ticket #4521 aperto da rossi@helpdesk.it", ("IP_ADDRESS", "EMAIL")),
    ("From: Mario Rossi <mario.rossi@cliente.it> To: support@acme.it Subject: Problema fattura", ("EMAIL",)),
    ("Cordiali saluti, Anna Bianchi - anna@studio.it - tel +39 011 1234567", ("EMAIL", "TELEFONO_IT")),
    ("Per emergenze contattare il sig. Verdi al 3401234567 oppure scrivere a verdi@azienda.it", ("TELEFONO_IT", "EMAIL")),
    ("PEC: amministrazione@acme.pec.it - per comunicazioni ufficiali", ("PEC",)),
    ("Paziente Rossi Mario, CF RSSMRA80A01L219M, tessera sanitaria 80380030001234567890", ("CODICE_FISCALE", "TESSERA_SANITARIA")),
    ("Referto medico per Bianchi Anna, CF BNCNNA75T41F205Y, contatto 3401234567", ("CODICE_FISCALE", "TELEFONO_IT")),
    ("Visita del 10/05/2024 presso ambulatorio, paziente con CF VRDLCU82M15H501J", ("CODICE_FISCALE",)),
    ("Veicolo targato AB123CD, proprietario Mario Rossi CF RSSMRA80A01L219M", ("TARGA_IT", "CODICE_FISCALE")),
    ("Targa moto FG12345 ritirata, contattare 011 1234567", ("TELEFONO_IT",)),
    ("Autoveicolo XY987ZW intestato a Beta SRL, P.IVA 01114601006", ("TARGA_IT", "PARTITA_IVA")),
    ("Documento d'identità AX1234567 di Anna Bianchi", ("CARTA_IDENTITA",)),
    ("Carta d'identità n. CA1234567AB rilasciata dal Comune di Torino", ("CARTA_IDENTITA",)),
    ("Pratica n. 2024/IT/4521, richiedente CF RSSMRA80A01L219M, indirizzo PEC pratiche@comune.pec.it", ("CODICE_FISCALE", "PEC")),
    ("Iscrizione all'albo: matricola 12345678, P.IVA 01114601006", ("MATRICOLA_INPS", "PARTITA_IVA")),
    ("Numero ordine 2024-12345 (non è un CF), prodotto codice ABC123", ()),
    ("P.IVA 01114601006 valida, IBAN IT60X0542811101000000123456, IP 8.8.8.8", ("PARTITA_IVA", "IBAN_IT", "IP_ADDRESS")),
)


def synthetic_cases(spark: SparkSession) -> DataFrame:
    """The synthetic cases as ``text, labels``."""
    return spark.createDataFrame([(t, list(labels)) for t, labels in CASES], "text string, labels array<string>")
