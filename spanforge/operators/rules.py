"""The patterns of the deterministic layer.

Fixed values: what each pattern matches is given. They are written for ``java.util.regex``
with Unicode-aware classes (flag U), so that word boundaries and digits are those of all
scripts. The address pattern is flat, one character class instead of a repeated group of
words, because a repeated group recurses once a word and overflows the stack on long lines;
it matches the same texts.
"""

from __future__ import annotations

from typing import NamedTuple

FISCAL_CODE = r"(?iU)\b[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]\b"
VAT_NUMBER = r"(?iU)\b(?:p\.?\s*iva|partita\s+iva|vat)\s*[:#]?\s*(?:IT\s*)?([0-9]{11})\b"
IBAN = r"(?iU)\bIT[0-9]{2}[A-Z][0-9A-Z]{22}\b"
PLATE = r"(?iU)\b[A-Z]{2}\s?[0-9]{3}\s?[A-Z]{2}\b"
IDENTITY_CARD = r"(?iU)\b(?:[A-Z]{2}[0-9]{7}|CA[0-9]{7}[A-Z]{2})\b"
MOBILE = r"(?U)(?<!\d)(?:(?:\+39|0039)[\s.-]?)?3[0-9]{2}[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}(?!\d)"
LANDLINE = r"(?U)(?<![A-Za-z0-9])(?:(?:\+39|0039)[\s.-]?)?0[0-9]{1,4}[\s.-]?[0-9]{4,8}(?!\d)"
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
IPV4 = r"(?U)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
HEALTH_CARD = r"(?U)(?<!\d)80[0-9]{18}(?!\d)"
SOCIAL_SECURITY = r"(?iU)\b(?:matricola(?:\s+inps)?|inps)\s*[:#]?\s*([0-9]{8,9})\b"
DOCUMENT_ID = r"(?iU)\bID-[A-Z0-9]{6,12}\b"
ADDRESS = (
    r"(?iU)\b(?:via|viale|piazza|piazzale|corso|largo|vicolo|lungarno|borgo|contrada|strada)"
    r"[ \t]+[\w'.][\w'. \t]*(?<=[\w'.])[ \t]+\d+"
    r"(?:[ \t]+(?:int\.?[ \t]*[\w/]+|scala[ \t]+\w+|piano[ \t]+\d+))?"
)

URL_LIKE = r"(?i)https?://|www\.|[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{2,}"
NAME_LIKE = r"^[A-ZÀ-Ÿa-zà-ÿ'-]+(?:(?U:\s)+[A-ZÀ-Ÿa-zà-ÿ'-]+)+\n?$"


class Rule(NamedTuple):
    """A pattern, its label, the group that is the value, and what a text must hold for it to match at all."""

    label: str
    pattern: str
    group: int = 0
    needs: str = "digit"


#: In the order in which equal spans are preferred.
RULES = (
    Rule("CODICE_FISCALE", FISCAL_CODE),
    Rule("PARTITA_IVA", VAT_NUMBER, 1),
    Rule("IBAN_IT", IBAN),
    Rule("TARGA_IT", PLATE),
    Rule("CARTA_IDENTITA", IDENTITY_CARD),
    Rule("CELL_IT", MOBILE),
    Rule("TEL_IT", LANDLINE),
    Rule("EMAIL", EMAIL, 0, "@"),
    Rule("IP_ADDRESS", IPV4),
    Rule("TESSERA_SANITARIA", HEALTH_CARD),
    Rule("MATRICOLA_INPS", SOCIAL_SECURITY, 1),
    Rule("DOCUMENTO_ID", DOCUMENT_ID, 0, "id-"),
    Rule("INDIRIZZO", ADDRESS),
)
