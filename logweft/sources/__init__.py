"""What is read: tables of events, images and their crops, sessions."""
