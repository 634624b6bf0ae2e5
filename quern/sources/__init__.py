"""Where tables come from: the registry of samples and top-K tables, DDL, files."""
