"""The eight-message sample archive."""

from email.message import Message
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

from pyspark.sql import DataFrame, SparkSession

from letterlens.sinks.messages import write_archive

# Sender, recipient, subject, Message-ID, charset, body of the sample messages.
SAMPLE = [
    ("Jan Novák <jan.novak@firma.cz>", "team@firma.cz", "Dovolená", "<abc123@server.com>", "utf-8",
     "Dobrý den,\n\nJsem na dovolené do 31.8. V případě potřeby kontaktujte kolegu.\n\nDěkuji"),
    ("Jane Smith <jane.smith@company.com>", "jan.novak@firma.cz", "Out of Office", "<xyz456@server.com>", "utf-8",
     "Hi,\n\nI am out of office until Monday. For urgent matters contact my colleague.\n\nBest regards"),
    ("Petr Svoboda <petr.svoboda@firma.cz>", "jan.novak@firma.cz, marie.nova@firma.cz", "Nemocenská",
     "<def789@server.com>", "utf-8",
     "Dobrý den,\n\nJsem na nemocenské od dneška. Vrátím se příští týden.\n\nS pozdravem"),
    ("Karel Vomacka <karel@firma.cz>", "jan.novak@firma.cz", "Dotaz na zprávu", "<ghi012@server.com>", "utf-8",
     "Ahoj,\n\nMohl bys mi poslat tu zprávu? Potřebuji ji na schůzku zítra.\n\nDíky"),
    ("Marie Nová <marie.nova@firma.cz>", "jan.novak@firma.cz", "Automatická odpověď: mimo kancelář",
     "<jkl345@server.com>", "utf-8", "Jsem mimo kancelář. Vrátím se za týden."),
    ("Anna Tesarova <anna@firma.cz>", "jan.novak@firma.cz", "FW: Info o dovolené", "<mno678@server.com>", "utf-8",
     "---------- Forwarded message ---------\nFrom: Someone\nSubject: Dovolená\n\nJsem na dovolené do konce měsíce."),
    ("random@other.com", "someone@other.com", "Dovolená plány", "<pqr901@server.com>", "utf-8",
     "Chceš jít na dovolenou společně?"),
    ("Tomáš Dvořák <tomas.dvorak@firma.cz>", "jan.novak@firma.cz", "Řádná dovolená", "<stu234@server.com>",
     "windows-1250", "Zdravím,\n\nČerpám řádnou dovolenou do 15.9.\n\nS pozdravem"),
]
SAMPLE_HTML = "<html><body><p>Jsem <b>mimo kancelář</b>. Vrátím se za týden.</p></body></html>"


def sample_messages() -> list[Message]:
    messages = []
    for number, (sender, to, subject, message_id, charset, text) in enumerate(SAMPLE, start=1):
        message = MIMEText(text, "plain", charset)
        if number == 5:
            plain, message = message, MIMEMultipart("alternative")
            message["Cc"] = "team@firma.cz"
            message.attach(plain)
            message.attach(MIMEText(SAMPLE_HTML, "html", charset))
        message["From"], message["To"], message["Subject"] = sender, to, subject
        message["Date"] = f"{['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][number % 7]}, {number + 1:02d} Jan 2024 08:00:00 +0100"
        message["Message-ID"] = message_id
        messages.append(message)
    return messages


def write_sample_archive(spark: SparkSession, path: str) -> DataFrame:
    """Write the sample as an archive folder; returns what was written."""
    rows = [(i, m.as_bytes()) for i, m in enumerate(sample_messages())]
    messages = spark.createDataFrame(rows, "place int, raw binary")
    write_archive(messages.coalesce(1), path, ["place"])
    return messages
