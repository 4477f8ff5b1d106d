"""Where rows come from and go to: files, logs, generators, tables."""
