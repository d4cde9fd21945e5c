"""Personal information inside free text: detection by a character BiLSTM-CRF and replacement by typed placeholders."""
