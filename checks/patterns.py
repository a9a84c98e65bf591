"""The patterns in their plain form, for the checks only."""

from __future__ import annotations

# The same rules in their plain form, without any speed-up, in
# the spelling that Python, RE2 and most engines share. Tests hold the
# library against these, and the SQL of the checks is written with them.
PLAIN = {
    "labeled_field": r"(?i)\b(?:password|pass(?:word)?|pin|cvv|cvc|exp(?:iry|iration)?|dob|d\.?o\.?b\.?|license|licence|api[_\- ]?key|secret|token|auth[_\- ]?token|access[_\- ]?key|private[_\- ]?key|routing[_\- ]?number)\s*[:=]\s*\S+",
    "email": r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b",
    "phone_international": r"\+\d{1,3}[ \-]?\(?\d{2,4}\)?[ \-]?\d{3,4}[ \-]?\d{3,4}\b",
    "phone_parentheses": r"\(\d{3}\)\s*\d{3}[ \-]?\d{4}\b",
    "phone_separated": r"\b\d{3}[ \-]\d{3}[ \-]\d{4}\b",
    "phone_dotted": r"\b\d{3}\.\d{3}\.\d{4}\b",
    "ssn": r"\b\d{3}[\- ]\d{2}[\- ]\d{4}\b",
    "url_token": r"(?i)\bhttps?://[^\s]+(?:token|apikey|api_key|api-key|auth|session|key|sig|signature|code|secret|password|access_token|refresh_token)=[^\s&]+[^\s]*",
    "account_like": r"\b(?:\d[ \-]?){10,19}\b",
    "date": r"\b(?:\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}|\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})\b",
    "address": r"(?i)\b\d{1,6}\s+[A-Za-z0-9][A-Za-z0-9.\- ]{2,40}\s(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|court|ct|place|pl|circle|cir|terrace|ter|parkway|pkwy|highway|hwy)\b(?:[^\n,]{0,40})",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "iban": r"\b[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?[A-Z0-9]{4}){1,7}(?: ?[A-Z0-9]{1,4})?\b",
    "passport": r"(?i)(?:passport\s*(?:no|number|#|num)?)\s*[:=]?\s*[A-Z0-9]{6,12}",
    "salutation": r"(?i:dear|hello|hi|hey|good\s+(?:morning|afternoon|evening))\s+([A-Z][a-z]{1,30}(?:\s+[A-Z][a-z]{1,30})?)\b",
    "sign_off": r"(?i:best|thanks|thank\s+you|regards|sincerely|cheers|warm\s+regards|kind\s+regards|yours\s+truly|respectfully)\s*,?\s*\r?\n\s*([A-Z][a-z]{1,30}(?:\s+[A-Z][a-z]{1,30})?)",
}
