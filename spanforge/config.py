"""Engine configuration and the fixed values of the detection rules."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

VERSION = "0.1.0"


class MaskingMode(StrEnum):
    """How a detected value is replaced."""

    REPLACE = "replace"
    REDACT = "redact"
    GENERALIZE = "generalize"
    HASH = "hash"


@dataclass(frozen=True)
class Config:
    """Driver-side settings. ``masking_mode`` is checked on construction."""

    opf_enabled: bool = True
    opf_recall_mode: str = "aggressive"
    gliner_enabled: bool = True
    gliner_threshold: float = 0.3
    pattern_enabled: bool = True
    #: labels of the rules that the pattern layer runs; all of them where None
    pattern_labels: tuple[str, ...] | None = None
    #: characters up to which neighbours of one label on one line become one span; with -1 only spans that overlap do
    merge_gap: int = 3
    masking_mode: MaskingMode | str = MaskingMode.REPLACE
    keep_metadata: bool = False
    recursive: bool = True
    low_memory: bool = False
    chunk_long_text: bool = True
    chunk_threshold: int = 4000
    chunk_size: int = 1500
    chunk_overlap: int = 100
    #: windows as rows of their own, dealt to all tasks; else those of a text stay in its row
    spread_windows: bool = False
    ocr_dpi: int = 300
    ocr_max_workers: int = 4
    ml_skip_extensions: tuple[str, ...] = (".log",)
    ml_skip_min_chars: int = 8000

    def __post_init__(self):
        object.__setattr__(self, "masking_mode", MaskingMode(self.masking_mode))

    @property
    def layers(self) -> list[str]:
        """Names of the enabled layers, in the order their spans are joined."""
        return [name for name, on in (("opf", self.opf_enabled), ("gliner", self.gliner_enabled), ("pattern", self.pattern_enabled)) if on]


# They must equal those that the rules are defined by.

#: Which layer wins where spans conflict.
PRIORITY = {"pattern": 3, "opf": 2, "gliner": 1}

#: Labels that change when spans are resolved; any other is upper-cased.
ALIASES = {"CELL_IT": "TELEFONO_IT", "TEL_IT": "TELEFONO_IT"}

#: Placeholder prefix by label; any other label is its own prefix.
PREFIXES = {
    "CODICE_FISCALE": "CF",
    "PARTITA_IVA": "PIVA",
    "IBAN_IT": "IBAN",
    "TARGA_IT": "TARGA",
    "CARTA_IDENTITA": "CI",
    "TELEFONO_IT": "TEL",
    "CELL_IT": "TEL",
    "TEL_IT": "TEL",
    "EMAIL": "EMAIL",
    "PEC": "PEC",
    "IP_ADDRESS": "IP",
    "TESSERA_SANITARIA": "TS",
    "MATRICOLA_INPS": "MATRICOLA",
}

#: Characters trimmed from spans of statistical layers.
TRIMMED = ", ;\t"

#: Words that are no personal data when they make up a whole span, in any case.
COMMON_WORDS = (
    "sesso",
    "cognome",
    "nome",
    "ruolo",
    "azienda",
    "provincia",
    "citta",
    "stato",
    "indirizzo",
    "cap",
    "data",
    "nota",
    "note",
    "email",
    "telefono",
    "cellulare",
    "roma",
    "milano",
    "napoli",
    "torino",
    "genova",
    "palermo",
    "bologna",
    "firenze",
    "venezia",
    "verona",
    "messina",
    "catania",
    "padova",
    "trieste",
    "brescia",
    "parma",
    "ravenna",
    "perugia",
    "modena",
    "reggio",
    "cagliari",
    "lecce",
    "analista",
    "tecnico",
    "manager",
    "impiegato",
    "operaio",
    "consulente",
    "specialista",
    "coordinatore",
    "responsabile",
    "direttore",
    "supervisore",
    "mouse",
    "monitor",
    "tastiera",
    "stampante",
    "schermo",
    "notebook",
    "laptop",
    "computer",
    "tablet",
    "server",
    "router",
    "webcam",
    "cuffie",
    "scanner",
    "smartphone",
    "fotocamera",
    "proiettore",
    "prodotto",
    "articolo",
    "servizio",
    "ordine",
    "fattura",
    "prezzo",
    "quantita",
    "descrizione",
    "categoria",
    "marca",
    "modello",
    "colore",
    "taglia",
)

#: Words for vehicles, which are no driving licences.
VEHICLES = (
    "autoveicolo",
    "motoveicolo",
    "ciclomotore",
    "rimorchio",
    "semirimorchio",
    "autovettura",
    "motociclo",
    "quadriciclo",
    "veicolo",
    "automezzo",
)

#: Labels of the zero-shot layer, and what they become; any other is upper-cased, with blanks as underscores.
GLINER_LABELS = {
    "person": "PERSONA",
    "organization": "ORGANIZZAZIONE",
    "email": "EMAIL",
    "phone number": "TELEFONO",
    "address": "INDIRIZZO",
    "date": "DATA_PRIVATA",
    "url": "URL",
    "username": "USERNAME",
    "password": "SECRET",
    "ip address": "IP_ADDRESS",
    "tax id": "TAX_ID",
    "social security number": "CODICE_FISCALE",
    "passport number": "PASSAPORTO",
    "driver license": "PATENTE",
    "health insurance id": "TESSERA_SANITARIA",
    "credit card number": "CARTA_CREDITO",
    "iban": "IBAN",
    "medical condition": "CONDIZIONE_MEDICA",
}

#: Labels of the typed layer, and what they become; any other is upper-cased.
OPF_LABELS = {
    "person": "PERSONA",
    "private_person": "PERSONA",
    "name": "PERSONA",
    "email": "EMAIL",
    "private_email": "EMAIL",
    "phone": "TELEFONO",
    "private_phone": "TELEFONO",
    "phone_number": "TELEFONO",
    "address": "INDIRIZZO",
    "private_address": "INDIRIZZO",
    "location": "LUOGO",
    "date": "DATA_PRIVATA",
    "private_date": "DATA_PRIVATA",
    "date_of_birth": "DATA_NASCITA",
    "url": "URL",
    "private_url": "URL",
    "account_number": "ACCOUNT_NUMBER",
    "iban": "IBAN",
    "credit_card": "CREDIT_CARD",
    "ssn": "SSN",
    "tax_id": "TAX_ID",
    "secret": "SECRET",
    "redacted": "PII",
}

#: Colours of highlighted spans by source.
COLOURS = {"pattern": "#ffd54f", "opf": "#90caf9", "gliner": "#a5d6a7"}
