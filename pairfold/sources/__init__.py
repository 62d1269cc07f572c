"""Readers and writers of structure, topology and column files, snapshots and manifests.

Readers give DataFrames with the file that a row is of; formats of one line per row are read line by line, those
whose lines depend on each other file by file, so that many files are read side by side. Lengths, energies and
charges are as they stand in the file.
"""
