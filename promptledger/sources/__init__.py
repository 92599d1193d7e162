"""Scans: driver tables, config tables, labelled / golden prompt files and
the derived fixture views every query and its SQL twin share."""
