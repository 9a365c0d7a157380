"""Where rows come from and go to: schemas, tables, observations, metrics text, synthetic churn."""
