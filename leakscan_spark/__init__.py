"""Credential scanning and security auditing over large tables and streams."""
