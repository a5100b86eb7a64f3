"""Reading and writing: star tables, curated versions, tariff sheets, audit logs."""
