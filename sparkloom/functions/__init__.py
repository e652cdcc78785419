"""Part of sparkloom; see README.md."""
