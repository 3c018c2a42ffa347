"""Writers: logs, messages, attachments, archives, reports."""
