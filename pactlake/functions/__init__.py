"""See the README for what lies here."""
