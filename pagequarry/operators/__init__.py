"""Decoders: binary columns to headers, pages, tags, entries and keys. All are narrow; none shuffles."""
